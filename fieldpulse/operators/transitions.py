"""Topic transitions: which topics merge, split or transfer between observed years.

Only topic pairs that share a work or an author are built.  All other candidate
pairs have both signals at 0; they enter the min-max scaling through their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, scaled, with_scalar
from ..session import materialise

# Score threshold, number of topics and signal weights.
THRESHOLD = 0.5
TOP_TOPICS = 30
STRUCTURAL_WEIGHT = 0.5
LEVEL_WEIGHT, TREND_WEIGHT = 0.6, 0.4
#: Topics held in one number.
MASK_BITS = 62

PAIR = ["src_topic_id", "tgt_topic_id", "year"]


def top_topics(tagged: DataFrame, n: int = TOP_TOPICS) -> DataFrame:
    """The ``n`` topics with most distinct works, ties by id; ``tagged`` is ``topic_works``."""
    return tagged.groupBy("topic_id").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "topic_id").limit(n)


def in_top(tagged: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of the top topics; ``top`` is the short list of ``top_topics`` and is broadcast."""
    return tagged.join(F.broadcast(top.select("topic_id")), "topic_id", "left_semi")


def work_topic_sets(chosen: DataFrame) -> DataFrame:
    """One row per work with its sorted topics, at most as many as the top list holds."""
    return chosen.groupBy("work_id", "year").agg(F.array_sort(F.collect_set("topic_id")).alias("topics"))


def _pairs(a: str, b: str) -> Column:
    return F.flatten(F.transform(a, lambda s: F.transform(
        F.filter(b, lambda t: t != s),
        lambda t: F.struct(s.alias("src_topic_id"), t.alias("tgt_topic_id")))))


def shared_works(sets: DataFrame) -> DataFrame:
    """Works tagged with both topics, per ordered pair and year.

    Works with the same topic set are counted first, then each set is opened once.
    """
    return (
        sets.groupBy("year", "topics").agg(F.count("*").alias("n"))
        .select("year", "n", F.explode(_pairs("topics", "topics")).alias("p"))
        .groupBy("p.src_topic_id", "p.tgt_topic_id", "year").agg(F.sum("n").alias("shared_works")))


def author_topic_sets(sets: DataFrame, authorships: DataFrame, keep_blank: bool = False) -> DataFrame:
    """One row per (author, year) with the author's topics of that year.

    Topics travel as bits of one number for every ``MASK_BITS`` of them, which add up on the map side; repeated
    authorships change no bit.  The driver reads the topics of the sets, a top list.
    """
    listed = sorted(r.topic_id for r in sets.select(F.explode("topics").alias("topic_id")).distinct().collect()
                    if r.topic_id is not None)
    chunks = [listed[i: i + MASK_BITS] for i in range(0, len(listed), MASK_BITS)] or [[]]

    def mask(chunk: list[str]) -> Column:
        held = [F.when(F.array_contains("topics", t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(chunk)]
        return reduce(Column.bitwiseOR, held, F.lit(0).cast("long"))

    names = [f"mask{i}" for i in range(len(chunks))]
    marked = sets.select("work_id", "year", *[mask(c).alias(n) for c, n in zip(chunks, names)])
    people = authorships if keep_blank else authorships.where(F.col("author_id") != "")
    found = people.select("work_id", "author_id").join(marked, "work_id").groupBy("author_id", "year").agg(
        *[F.bit_or(n).alias(n) for n in names])
    topics = [_bits_read(F.col(n), c[i: i + 4], i) for c, n in zip(chunks, names) for i in range(0, len(c), 4)]
    return found.where(" or ".join(f"{n} <> 0" for n in names)).select(
        "author_id", "year", F.concat(*topics, F.array().cast("array<string>")).alias("topics"))


def _bits_read(mask: Column, piece: list[str], first: int) -> Column:
    """The topics of four bits, looked up in a constant table."""
    table = F.array(*[F.array(*[F.lit(t) for i, t in enumerate(piece) if v >> i & 1]).cast("array<string>") for v in range(1 << len(piece))])
    return F.get(table, F.shiftright(mask, first).bitwiseAND(F.lit(15).cast("long")).cast("int"))


def observed_years(df: DataFrame) -> DataFrame:
    """One row with the sorted array of the distinct years."""
    return df.agg(F.array_sort(F.collect_set("year")).alias("years"))


def neighbour_year(df: DataFrame, years: DataFrame, step: int, name: str) -> DataFrame:
    """Add the observed year ``step`` places away from ``year``; null beyond the ends."""
    place = F.array_position("_years", F.col("year")) + step
    return with_scalar(df, "_years", years).withColumn(
        name, F.when(place > 0, F.try_element_at("_years", place.cast("int")))).drop("_years")


def shared_authors(author_sets: DataFrame, years: DataFrame) -> DataFrame:
    """Authors of the source topic in a year who are in the target topic the next observed year.

    An author's consecutive years are neighbours in a window; equal combinations
    of topic sets are counted before they are opened into pairs.
    """
    own = Window.partitionBy("author_id").orderBy("year")
    steps = author_sets.select(
        "year", "topics", F.lead("year").over(own).alias("then"),
        F.lead("topics").over(own).alias("then_topics"),
    )
    steps = neighbour_year(steps, years, 1, "next_year").where(F.col("then") == F.col("next_year"))
    return (
        steps.groupBy("year", "topics", "then_topics").agg(F.count("*").alias("n"))
        .select("year", "n", F.explode(_pairs("topics", "then_topics")).alias("p"))
        .groupBy("p.src_topic_id", "p.tgt_topic_id", "year").agg(F.sum("n").alias("shared_authors")))


def topic_sizes(sets: DataFrame, author_sets: DataFrame, years: DataFrame) -> DataFrame:
    """Works and authors per topic and year, with the next observed year."""
    works = sets.select("year", F.explode("topics").alias("topic_id")).groupBy("year", "topic_id").agg(
        F.count("*").alias("works")).select("topic_id", "year", "works", F.lit(0).alias("authors"))
    people = author_sets.select("year", F.explode("topics").alias("topic_id")).groupBy("year", "topic_id").agg(
        F.count("*").alias("authors")).select("topic_id", "year", F.lit(0).alias("works"), "authors")
    sizes = works.unionByName(people).groupBy("topic_id", "year").agg(
        F.sum("works").alias("works"), F.sum("authors").alias("authors"))
    return neighbour_year(sizes, years, 1, "next_year")


def structural_signal(now: Column, then: Column) -> Column:
    """Overlap level next year plus its rise, never negative."""
    return LEVEL_WEIGHT * then + TREND_WEIGHT * F.greatest(F.lit(0.0), then - now)


def pair_signals(sets: DataFrame, author_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, sizes)``: both signals for every candidate pair that has any overlap."""
    years = observed_years(sets)
    sizes = topic_sizes(sets, author_sets, years)
    together = shared_works(sets)
    # The overlap of a year is also the later overlap of the observed year before it.
    earlier = neighbour_year(together, years, -1, "before").where(F.col("before").isNotNull())
    none = F.lit(0).cast("long")
    parts = together.select(*PAIR, F.col("shared_works").alias("now"), none.alias("then"),
                            none.alias("moved"))
    parts = parts.unionByName(earlier.select(
        *PAIR[:2], F.col("before").alias("year"), none.alias("now"), F.col("shared_works").alias("then"),
        none.alias("moved")))
    parts = parts.unionByName(shared_authors(author_sets, years).select(
        *PAIR, none.alias("now"), none.alias("then"), F.col("shared_authors").alias("moved")))
    met = parts.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("now", "then", "moved")])
    src = sizes.where(F.col("authors") > 0).select(
        F.col("topic_id").alias("src_topic_id"), "year", "next_year",
        F.col("works").alias("src_works"), F.col("authors").alias("src_authors"))
    later = sizes.select(F.col("topic_id").alias("src_topic_id"), F.col("year").alias("next_year"),
                         F.col("works").alias("src_works_next"))
    target = sizes.select(F.col("topic_id").alias("tgt_topic_id"), F.col("year").alias("next_year"))
    pairs = (
        met.join(src, ["src_topic_id", "year"])
        .join(later, ["src_topic_id", "next_year"], "left")
        .join(target, ["tgt_topic_id", "next_year"], "left_semi"))
    zero = F.lit(0.0)
    overlap_now = F.coalesce(ratio(F.col("now"), F.col("src_works")), zero)
    overlap_then = F.coalesce(ratio(F.col("then"), F.col("src_works_next")), zero)
    pairs = pairs.select(
        *PAIR, "next_year", overlap_now.alias("overlap_now"), overlap_then.alias("overlap_then"),
        structural_signal(overlap_now, overlap_then).alias("structural"),
        ratio(F.col("moved"), F.col("src_authors")).alias("behavioral"),
        F.col("moved").alias("shared_authors"))
    return pairs, sizes


def candidate_count(sizes: DataFrame) -> DataFrame:
    """One row with the number of candidate pairs, without building them."""
    sources = sizes.where((F.col("authors") > 0) & F.col("next_year").isNotNull()).groupBy(
        "next_year").agg(F.count("*").alias("sources"))
    targets = sizes.groupBy(F.col("year").alias("next_year")).agg(F.count("*").alias("targets"))
    present = sizes.select("topic_id", F.col("year").alias("next_year"))
    same = sizes.where(F.col("authors") > 0).join(
        present, ["topic_id", "next_year"], "left_semi").groupBy("next_year").agg(
        F.count("*").alias("same"))
    return sources.join(targets, "next_year").join(same, "next_year", "left").agg(
        F.coalesce(F.sum(F.col("sources") * F.col("targets") - F.coalesce("same", F.lit(0))),
                   F.lit(0)).alias("candidates"))


def _all_candidates(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every candidate pair, zero rows included: at most top² per year."""
    src = sizes.where(F.col("authors") > 0).select(
        F.col("topic_id").alias("src_topic_id"), "year", "next_year")
    tgt = sizes.select(F.col("topic_id").alias("tgt_topic_id"), F.col("year").alias("next_year"))
    wide = src.join(tgt, "next_year").where(F.col("src_topic_id") != F.col("tgt_topic_id"))
    return wide.join(pairs.drop("next_year"), PAIR, "left").na.fill(0)


def scored_pairs(pairs: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD,
                 weight: float = STRUCTURAL_WEIGHT) -> DataFrame:
    """Combined score of the pairs that reach ``threshold``.

    The scaling covers all candidates: where some are not listed, their zeros
    take part in the minimum.  Not listed pairs score 0, so they can only be kept
    by a threshold that is not positive; then all candidates are built.
    """
    if threshold <= 0:
        pairs = _all_candidates(pairs, sizes)
    signals = ("structural", "behavioral")
    bounds = pairs.agg(F.struct(F.count("*").alias("n"), *[
        f(c).alias(f"{name}_{c}") for c in signals for name, f in (("lo", F.min), ("hi", F.max))
    ]).alias("b"))

    def norm(c: str) -> Column:
        lo = F.col(f"_b.lo_{c}")
        lo = F.when(F.col("_b.n") < F.col("_total"), F.least(lo, F.lit(0.0))).otherwise(lo)
        return scaled(F.col(c), lo, F.col(f"_b.hi_{c}"))

    score = weight * norm("structural") + (1 - weight) * norm("behavioral")
    known = with_scalar(with_scalar(pairs, "_b", bounds), "_total", candidate_count(sizes))
    return known.withColumn("combined_score", score).where(
        F.round("combined_score", 12) >= threshold).drop("_b", "_total")


def classify_transitions(kept: DataFrame) -> DataFrame:
    """Merge when several sources meet in the target, else split, else transfer.

    A group has at most as many rows as there are top topics.
    """
    fan_in = F.count("*").over(Window.partitionBy("tgt_topic_id", "next_year"))
    fan_out = F.count("*").over(Window.partitionBy("src_topic_id", "year"))
    return kept.withColumn("transition_type", F.when(fan_in > 1, "merge").when(
        fan_out > 1, "split").otherwise("transfer"))


def topic_transitions(tagged: DataFrame, names: DataFrame, authorships: DataFrame, threshold: float = THRESHOLD,
                      top_n: int = TOP_TOPICS, weight: float = STRUCTURAL_WEIGHT,
                      keep_blank: bool = False) -> DataFrame:
    """The transition table with its signals, from ``topic_works`` and ``topic_names``.

    The topic sets of works and authors are each read several times and are
    written once, as are the small pair and size tables made from them.
    """
    top = materialise(top_topics(tagged, top_n).join(names, "topic_id"))
    sets = materialise(work_topic_sets(in_top(tagged, top)))
    author_sets = materialise(author_topic_sets(sets, authorships, keep_blank))
    pairs, sizes = (materialise(t) for t in pair_signals(sets, author_sets))
    kept = classify_transitions(scored_pairs(pairs, sizes, threshold, weight))

    def named(side: str) -> DataFrame:
        return F.broadcast(top.select(F.col("topic_id").alias(f"{side}_topic_id"),
                                      F.col("topic_name").alias(f"{side}_topic_name")))

    return kept.join(named("src"), "src_topic_id").join(named("tgt"), "tgt_topic_id").select(
        "src_topic_id", "tgt_topic_id", "src_topic_name", "tgt_topic_name", "year", "next_year",
        F.col("shared_authors").cast("int").alias("overlap_count"),
        F.col("combined_score").alias("overlap_ratio"), "transition_type",
        "structural", "behavioral")


def transition_summary(transitions: DataFrame) -> DataFrame:
    """Counts by type and the mean signals over all kept transitions."""
    return transitions.agg(
        F.count("*").alias("transitions"),
        *[F.count_if(F.col("transition_type") == t).alias(t + "s")
          for t in ("merge", "split", "transfer")],
        F.avg("structural").alias("avg_structural"), F.avg("behavioral").alias("avg_behavioral"))
