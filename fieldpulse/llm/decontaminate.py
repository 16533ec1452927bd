r"""Benchmark passages in documents, found by winnowing.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  A window is ``WINDOW`` consecutive words of an
item; an item of fewer words is one window.  Every document word inside an occurrence of a window is hit.

Winnowing: of every ``WINDOW - GRAM + 1`` neighbouring grams of ``GRAM`` words the one with the smallest
hash (the last on a tie) is kept.  The choice depends on the window's words alone, so a shared window
has the same kept gram on both sides, and no span of ``WINDOW`` words or more is missed.  A kept
document gram that passes a small Bloom filter of the kept item grams carries the few words
around it to an equi-join with the item grams; comparing these words extends the hit to
both sides, and a span of at least ``WINDOW`` words counts.  The filter has a fixed size and only saves
work: what passes is decided by the join.  Items shorter than a window are looked for as a whole, with grams
of their own length.

All steps are DataFrame expressions.  Equal surroundings of item grams are joined once, whatever the number
of items that hold them.

Edge cases: null and empty texts have no words; a null ``doc_id`` is judged like any other; rows with the
same id and text share their result; items without words match nothing; an empty benchmark leaves
every document clean; other columns are ignored; ids of items are compared as strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
SIDE = WINDOW - GRAM  # words that a window can reach beyond a gram
#: Bits for the place of a gram in its text; a string has fewer than 2**30 words.
PLACE_BITS = 30
#: Words (64 bits each) of the Bloom filter of item grams: 1 MB, whatever the benchmark.
FILTER_WORDS = 1 << 17
FILTER_HASHES = 2


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; only the first and the last part of a split can be empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)

    def inner(parts: Column) -> Column:
        n = F.size(parts)
        lead = (F.get(parts, F.lit(0)) == "").cast("int")
        tail = (F.get(parts, n - 1) == "").cast("int")
        return F.slice(parts, lead + 1, F.greatest(n - lead - tail, F.lit(0)))
    return bind(F.split(lowered, NO_WORD), inner)


def _counted(first: Column | int, last: Column) -> Column:
    """``first .. last``, empty when ``last`` is smaller."""
    first = F.lit(first)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _packed(gram: Column, place: Column) -> Column:
    """Hash and place in one number: the smallest has the smallest hash, then the last place."""
    high = F.shiftleft(F.shiftright(gram, PLACE_BITS), PLACE_BITS)
    return high + (F.lit((1 << PLACE_BITS) - 1) - place)


def _place(packed: Column) -> Column:
    low = packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (F.lit((1 << PLACE_BITS) - 1) - low).cast("int")


def kept_grams(words: Column) -> Column:
    """The winnowed grams of one text as packed numbers."""
    n = F.size(words)
    grams = F.transform(_counted(0, n - GRAM), lambda i: _packed(
        F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]), i))
    return bind(grams, lambda g: F.array_distinct(F.transform(
        _counted(0, n - WINDOW), lambda s: F.least(*[F.get(g, s + j) for j in range(SIDE + 1)]))))


def _around(words: Column, packed: Column) -> Column:
    """A kept gram with the words it may be extended by."""
    at = _place(packed)
    before = F.least(at, F.lit(SIDE))
    return F.struct(
        F.shiftright(packed, PLACE_BITS).alias("h"), at.alias("at"),
        F.slice(words, at + 1, GRAM).alias("gram"),
        F.reverse(F.slice(words, at + 1 - before, before)).alias("before"),
        F.slice(words, at + 1 + GRAM, SIDE).alias("after"))


def _whole(words: Column, size: int) -> Column:
    """All grams of ``size`` words in the same form; ``h`` also depends on the size."""
    none = F.array().cast("array<string>")
    return F.transform(_counted(0, F.size(words) - size), lambda i: F.struct(
        F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]).alias("h"), i.alias("at"),
        F.slice(words, i + 1, size).alias("gram"), none.alias("before"), none.alias("after")))


def _bits(h: Column) -> list[Column]:
    """Places in the filter, taken from different bits of the hash."""
    mask = F.lit(FILTER_WORDS * 64 - 1)
    return [F.shiftright(h, 11 * i).bitwiseAND(mask) for i in range(FILTER_HASHES)]


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6).cast("int")


def _in_word(bit: Column) -> Column:
    return bit.bitwiseAND(F.lit(63)).cast("int")


def _filter_of(hashes: DataFrame) -> DataFrame:
    """One row ``filter``: the Bloom filter of the column ``h`` as an array of 64-bit words."""
    marked = hashes.select(F.explode(F.array(*_bits(F.col("h")))).alias("bit")).select(
        _word(F.col("bit")).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    blank = hashes.sparkSession.range(FILTER_WORDS).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    return (
        marked.union(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        .agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
        .select(F.transform("words", lambda w: w["mask"]).alias("filter")))


def _may_hold(bloom: Column, h: Column) -> Column:
    tests = [F.getbit(F.get(bloom, _word(b)), _in_word(b)) == 1 for b in _bits(h)]
    return reduce(lambda x, y: x & y, tests)


def _same(a: Column, b: Column) -> Column:
    """How many leading words of two short arrays agree."""
    run, total = F.lit(True), F.lit(0)
    for i in range(SIDE):
        run = run & F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        total = total + F.when(run, 1).otherwise(0)
    return total


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counted, spans, found)``: ``(key, copy, n_words)`` of every row; ``(key, copy, start, end)`` of hit word
    ranges; and the distinct ``(key, copy, item)``.  ``copy`` is a hash of the text: with the key it names a row.
    """
    listed = materialise(items.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
                         .where(F.size("words") > 0).distinct())
    short = sorted(r[0] for r in listed.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect())
    long_grams = listed.where(F.size("words") >= WINDOW).select(
        "item", F.explode(bind(F.col("words"), lambda w: F.transform(kept_grams(w), lambda p: _around(w, p)))).alias("g"))
    grams = [long_grams] + [
        listed.where(F.size("words") == size).select("item", F.explode(_whole(F.col("words"), size)).alias("g"))
        for size in short]
    grams = materialise(reduce(DataFrame.union, grams).select(
        "item", "g.h", "g.gram", "g.before", "g.after").distinct())
    surroundings = materialise(
        grams.select("h", "gram", "before", "after").distinct()
        .withColumn("id", F.xxhash64("gram", "before", "after")))
    bloom = materialise(_filter_of(surroundings.select("h").distinct()))

    def probes(w: Column, held: Column) -> Column:
        kept = F.filter(kept_grams(w), lambda p: _may_hold(held, F.shiftright(p, PLACE_BITS)))
        parts = [F.transform(kept, lambda p: _around(w, p))]
        parts += [F.filter(_whole(w, size), lambda g: _may_hold(held, g["h"])) for size in short]
        return F.concat(*parts)

    # the filter comes as an attribute, because subqueries are not allowed inside of array functions, and
    # is named once, so that the optimiser puts it back and no row carries a copy
    with_filter = docs.select(
        F.col(key), F.xxhash64(F.col(text)).alias("copy"), words_of(F.col(text)).alias("words"),
    ).withColumn("held", bloom.scalar())
    scanned = materialise(with_filter.select(
        key, "copy", bind(F.col("held"), lambda held: bind(F.col("words"), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), probes(w, held).alias("probes")))).alias("s"),
    ).select(key, "copy", "s.*"))

    probe = scanned.where(F.size("probes") > 0).select(F.col(key), "copy", F.explode("probes").alias("p"))
    known = surroundings.select("h", "id", *[F.col(c).alias(f"i_{c}") for c in ("gram", "before", "after")])
    met = (
        probe.select(key, "copy", "p.*").join(known, "h").where(F.col("gram") == F.col("i_gram"))
        .withColumn("left", _same(F.col("before"), F.col("i_before")))
        .withColumn("right", _same(F.col("after"), F.col("i_after")))
        .withColumn("start", F.col("at") - F.col("left"))
        .withColumn("end", F.col("at") + F.size("gram") + F.col("right")))
    # a gram of a longer item has words beside it; a whole short item has none and is not extended
    is_short = (F.size("i_before") == 0) & (F.size("i_after") == 0)
    hits = materialise(
        met.where((F.col("end") - F.col("start") >= WINDOW) | is_short).select(key, "copy", "id", "start", "end"))
    owners = grams.select(F.xxhash64("gram", "before", "after").alias("id"), "item").distinct()
    found = hits.select(key, "copy", "id").distinct().join(owners, "id").select(key, "copy", "item").distinct()
    return scanned.select(key, "copy", "n_words"), hits.select(key, "copy", "start", "end"), found


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, copy, n_words, n_hit, items)`` of every row; ``items`` are the found ids, sorted as strings."""
    counted, spans, found = benchmark_hits(docs, items, key, text, item, item_text)
    hit = (
        spans.distinct().select(key, "copy", F.explode(F.sequence("start", F.col("end") - 1)).alias("word"))
        .distinct().groupBy(key, "copy").agg(F.count("*").alias("n_hit")))
    named = found.groupBy(key, "copy").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed(key, "_key").withColumnRenamed("copy", "_copy")
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("copy") == F.col("_copy"))
        return left.join(right, same, "left").drop("_key", "_copy")

    return joined(joined(counted, hit), named).select(
        key, "copy", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item."""
    _, spans, _ = benchmark_hits(docs, items, key, text, item, item_text)
    names = [fresh(docs, name) for name in ("key", "copy")]
    dirty = spans.select(F.col(key).alias(names[0]), F.col("copy").alias(names[1])).distinct()
    same = F.col(key).eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(text)) == F.col(names[1]))
    return docs.join(dirty, same, "left_anti")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name
