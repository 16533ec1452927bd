"""Near-duplicate texts by word shingles: Jaccard of at least 0.8, checked exactly on MinHash candidates.

A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a text is the set of its shingles of five words (all
words of a shorter text).  Two texts link when they share at least ``SHARE`` of all their shingles;
groups are the connected components of the links.

Families: ``BANDS`` bands of ``ROWS`` minimum hashes each; texts that agree in a band, and all that hang together
so, are one family.  A pair of Jaccard 0.8 is in no common family with probability (1 - 0.8 ** ROWS) ** BANDS at
most, 3 in a million, a more alike one more rarely.  Only distinct word sequences take part, so copies never meet.

Within a family every text is written as its difference from a core, the shingles of more than half of a few
members: ``q`` shingles of the core, the missing ones ``lost`` and the other ones ``own``.  Shared shingles of two texts
are those of the core that neither lost and those that both own, so links need the differences alone, and any core
gives the same links.  What is compared, from cheap to dear:

1. Texts at a Jaccard distance of half the allowed one from the core all link with each other (triangle inequality).
2. Every text is compared with the family's text closest to the core.
3. Of two texts that are not yet in one group, a link needs a shared own shingle or enough core.  For the first,
   texts meet in the rarest of their own shingles (a prefix filter, as long as ``_prefix`` proves necessary), first with the
   smallest text there, then with all of other groups.  For the second, texts meet by classes of size and of the largest
   partner their share of the core allows; classes that cannot link never meet.

So a family of many edited copies takes work in proportion to its texts and to the pairs that these bounds cannot
tell apart.  No pair that could link is left out.

Texts of families, and of rows that go, are picked by a bitmap of fixed size before they are shuffled; other
texts stay where they are.  With very many of them the bitmap fills up and more texts are shuffled.

Rows that an explode has multiplied are joined by merging: Spark sizes them like the rows they come from and would send them
to the driver.

Edge cases: null, empty and blank texts are one group; a null key never makes a row go and no row go
for it; repeated keys with different texts are judged row by row; of rows that repeat key and text one
stays; shingles and sequences are compared by 64-bit hashes; other columns may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import scan
from .components import components

SHINGLE = 5
#: Least Jaccard similarity of a link, as a fraction of whole numbers.
SHARE = (4, 5)
ROWS, BANDS = 5, 32
#: Bits of the bitmap that picks texts, and of one of its pieces.
PICK_BITS, PIECE_BITS = 1 << 24, 1 << 15
#: Members that a core is taken from, and members of a family that are worked on under one key.
CORE_MEMBERS, BLOCK = 24, 256
#: Classes of sizes: a size in one class is less than this factor above the smallest one there.
CLASS_STEP = 1.02

_U = np.uint64
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) << _U(1) | _U(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, first, node)``: shingles in the order of texts, the first of each text (one more at the
    end), and a hash of the word sequence of each text."""
    words = scan.words(pc.ascii_lower(pc.fill_null(texts, "")), scan.SPACE)
    own, first = words.hashes(), words.first
    n = np.diff(first)
    node = np.zeros(len(n), np.uint64)
    place = np.arange(len(own)) - np.repeat(first[:-1], n)
    some = np.flatnonzero(n)
    if len(some):
        node[some] = scan.mix(np.add.reduceat(own * scan.powers(int(n.max()))[place], first[:-1][some]) + n[some].astype(np.uint64))
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    padded = np.concatenate([scan.windows(own, SHINGLE), np.zeros(SHINGLE, np.uint64)])
    found = padded[np.minimum(at, len(padded) - 1)]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    found[begin[:-1][short]] = node[short]
    return found, begin, node


def band_hashes(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of each text that has shingles, in their order."""
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(some), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS if len(some) else []):
        least = np.minimum.reduceat(found * factor, begin[:-1][some])
        band = i // ROWS
        out[:, band] = scan.mix(out[:, band] + least + _U(band))
    return out


def copy_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, copy, node, bands)`` of every row; ``copy`` is a hash of the text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in scan.pieces(texts):
                found, begin, node = shingles(texts.slice(lo, hi - lo))
                bands = band_hashes(found, begin)
                offsets = np.concatenate([[0], np.cumsum((np.diff(begin) > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(node.view(np.int64)), lists], ["key", "copy", "node", "bands"])

    return docs.select(docs[key].alias("key"), copy_of(docs[text]).alias("copy"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, copy bigint, node bigint, bands array<bigint>")


def _place(key: Column, copy: Column) -> Column:
    return F.pmod(F.xxhash64(key, copy), F.lit(PICK_BITS))


def marked(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(row, key, copy, hit)`` of ``docs``; ``hit`` is false only where ``(key, copy)`` is not among ``rows``."""
    place = _place(F.col("key"), F.col("copy"))
    bits = rows.groupBy(F.floor(place / PIECE_BITS).alias("piece")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(PIECE_BITS))).alias("bits"))
    placed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[key].alias("key"),
                         copy_of(docs[text]).alias("copy"))
    placed = placed.withColumn("piece", F.floor(place / PIECE_BITS)).withColumn("at", F.pmod(place, F.lit(PIECE_BITS)).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, at % 8)")) > 0, F.lit(False))
    return placed.join(F.broadcast(materialise(bits)), "piece", "left").select("row", "key", "copy", hit.alias("hit"))


def _sets(docs: DataFrame, own: DataFrame, families: DataFrame, key: str, text: str) -> DataFrame:
    """``(family, block, node, s)``: distinct shingles of one text per node of a family."""
    rows = materialise(own.join(families, "node").groupBy("node", "family").agg(
        F.min(F.struct("key", "copy")).alias("row")).select("node", "family", "row.*"))
    picked = marked(docs.select(docs[key].alias("key"), docs[text].alias("text")), rows, "key", "text").where("hit")
    picked = picked.select("key", "copy", "row.text")
    one = rows.join(picked, rows["key"].eqNullSafe(picked["key"]) & (rows["copy"] == picked["copy"])).select(
        "family", "node", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in scan.pieces(texts):
                found, begin, _ = shingles(texts.slice(lo, hi - lo))
                own = [np.unique(found[begin[i]: begin[i + 1]]) for i in range(hi - lo)]
                offsets = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], ["family", "node", "s"])

    found = one.mapInArrow(run, "family bigint, node bigint, s array<bigint>")
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return materialise(found.join(sizes, "family").select(
        "family", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "blocks", "node", "s"))


def _per_block(table: DataFrame) -> DataFrame:
    """A row per family (with its ``blocks``) repeated for each of its blocks."""
    return table.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _differences(sets: DataFrame) -> DataFrame:
    """``(family, block, blocks, node, core, size, q, lost, own)`` of every node; ``core`` is the size of its family's core."""
    order = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
    some = materialise(sets.select("family", "node", F.row_number().over(order).alias("rank")).where(F.col("rank") <= CORE_MEMBERS))
    chosen = sets.join(some.select("node"), "node", "left_semi")
    counts = chosen.select("family", F.explode("s").alias("shingle")).groupBy("family", "shingle").count()
    members = some.groupBy("family").agg(F.max("rank").alias("members"))
    cores = counts.join(members, "family").where(F.col("count") * 2 > F.col("members")).groupBy("family").agg(
        F.collect_list("shingle").alias("c"))
    blocks = sets.select("family", "blocks").distinct()
    cores = _per_block(materialise(blocks.join(cores, "family", "left").select(
        "family", "blocks", F.coalesce("c", F.array().cast("array<bigint>")).alias("c"))))
    return materialise(
        sets.join(cores, ["family", "block"])
        .select("family", "block", "blocks", "node", F.size("c").alias("core"), F.size("s").alias("size"),
                F.array_except("c", "s").alias("lost"), F.array_except("s", "c").alias("own"))
        .withColumn("q", F.col("core") - F.size("lost")))


def _links_when(shared: Column, a: Column, b: Column) -> Column:
    """Whether texts of ``a`` and ``b`` shingles with so many ``shared`` ones link."""
    return shared * (SHARE[0] + SHARE[1]) >= (a + b) * SHARE[0]


def _compared(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs ``(core, x, y)`` that link; ``x`` and ``y`` are structs of nodes' differences."""
    shared = F.col("core") - F.size(F.array_union("x.lost", "y.lost")) + F.size(F.array_intersect("x.own", "y.own"))
    return pairs.where(_links_when(shared, F.col("x.size"), F.col("y.size"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _side(table: DataFrame, name: str) -> DataFrame:
    """Nodes under ``name`` with their differences as a struct."""
    return table.select(F.col("node").alias(name), F.struct("node", "size", "lost", "own").alias(name + "_own"),
                        F.col("core").alias(name + "_core"))


def _checked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of one family that link."""
    both = pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b")
    return _compared(both.select(F.col("a_core").alias("core"), F.col("a_own").alias("x"), F.col("b_own").alias("y")))


def _core_links(nodes: DataFrame) -> DataFrame:
    """Links among nodes near the core, and of all nodes with the one closest to it."""
    union = F.col("core") + F.size("own")
    # half the distance: 2 (union - q) / union <= 1 - SHARE
    near = (union - F.col("q")) * 2 * SHARE[1] <= union * (SHARE[1] - SHARE[0])
    rank = F.struct((F.col("q") / F.greatest(union, F.lit(1))).alias("j"), F.col("node"))
    first = nodes.groupBy("family").agg(
        F.min(F.when(near, F.col("node"))).alias("least"), F.max(rank)["node"].alias("closest"), F.max("blocks").alias("blocks"))
    first = materialise(first)
    starts = _per_block(first.select("family", "blocks", "least"))
    clique = nodes.where(near).join(starts, ["family", "block"]).select(F.col("least").alias("a"), F.col("node").alias("b"))
    hubs = materialise(nodes.join(first.select(F.col("closest").alias("node")), "node", "left_semi").select(
        "family", "blocks", F.struct("node", "size", "lost", "own").alias("x")))
    met = nodes.join(_per_block(hubs), ["family", "block"]).select(
        "core", "x", F.struct("node", "size", "lost", "own").alias("y"))
    return clique.union(_compared(met)).where("a <> b")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes, with the ``root`` of their group, of families that are not yet one group."""
    known = nodes.select("family", "node").join(components(links), "node", "left").select(
        "family", "node", F.coalesce("root", "node").alias("root"))
    known = materialise(known)
    opened = known.groupBy("family").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return materialise(known.join(opened.select("family"), "family"))


def _prefix() -> Column:
    """Own shingles, rarest first, of which a text must share one with any partner that has not enough core alone.

    A partner of ``y`` shingles needs ``(size + y) * 4 / 9`` shared ones, of which the core gives ``q`` at most; ``y`` is at
    least 0.8 of the size, and at least what it has of the core.
    """
    whole = SHARE[0] + SHARE[1]
    partner = F.greatest(F.ceil(F.col("size") * SHARE[0] / SHARE[1]), F.col("q"))
    needed = F.ceil((F.col("size") + partner) * SHARE[0] / whole) - F.col("q")
    # a partner with less of the core than this text needs more, so the bound holds for all
    return F.size("own") - F.greatest(needed, F.lit(1)) + 1


def _shared_shingles(nodes: DataFrame) -> DataFrame:
    """``(family, shingle, node)``: the prefixes of the nodes, without shingles that only one node owns."""
    owned = nodes.select("family", "node", _prefix().alias("upto"), F.size("own").alias("n"), F.explode("own").alias("shingle"))
    common = owned.groupBy("family", "shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    met = owned.hint("merge").join(common, ["family", "shingle"])
    order = Window.partitionBy("node").orderBy("seen", "shingle")
    per_node = Window.partitionBy("node")
    ranked = met.select("family", "node", "shingle", "upto", "n", F.row_number().over(order).alias("rank"),
                        F.count("*").over(per_node).alias("kept"))
    return ranked.where("rank + n - kept <= upto").select("family", "shingle", "node")  # those before are its alone


def _core_pairs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(a, b)`` of different groups whose shared core might be enough.

    Both have at least ``(size + size) * 4 / 9`` of the core, so each allows partners of up to ``most`` shingles.
    """
    whole = SHARE[0] + SHARE[1]
    most = F.floor((F.col("q") * whole - F.col("size") * SHARE[0]) / SHARE[0])
    step = float(np.log(CLASS_STEP))
    klass = lambda c: F.floor(F.log(c) / F.lit(step)).cast("int")
    able = nodes.where((F.col("size") > 0) & (most * SHARE[1] >= F.col("size") * SHARE[0]) & (most > 0)).join(roots.select("node", "root"), "node")
    able = materialise(able.select("family", "node", "root", "size", most.alias("most"), klass(F.col("size")).alias("s"),
                                   klass(most).alias("m")))
    cells = able.groupBy("family", "s", "m").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    left = cells.where("s <= m").select("family", *[F.col(c).alias(c + "_a") for c in ("s", "m", "low", "high")],
                                        F.explode(F.sequence("s", "m")).alias("s_b"))  # the larger text is sought
    right = cells.select("family", *[F.col(c).alias(c + "_b") for c in ("s", "m", "low", "high")])
    meeting = materialise(
        left.hint("merge").join(right, ["family", "s_b"])
        .where("s_a <= m_b and (s_a < s_b or m_a <= m_b) and (low_a <> low_b or low_a <> high_a or low_b <> high_b)")
        .select("family", "s_a", "m_a", "s_b", "m_b"))
    one = able.select("family", *[F.col(c).alias(c + "_a") for c in ("s", "m", "root", "size", "most")], F.col("node").alias("x"))
    two = able.select("family", *[F.col(c).alias(c + "_b") for c in ("s", "m", "root", "size", "most")], F.col("node").alias("y"))
    met = meeting.join(one, ["family", "s_a", "m_a"]).join(two, ["family", "s_b", "m_b"])
    return met.where("root_a <> root_b and size_a <= most_b and size_b <= most_a").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links_of(docs: DataFrame, own: DataFrame, families: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b)`` of nodes: enough links to tell the groups within ``families`` (``node, family``)."""
    nodes = _differences(_sets(docs, own, families, key, text))
    links = materialise(_core_links(nodes))
    roots = _rooted(nodes, links)
    if roots.isEmpty():
        return links
    left = nodes.join(roots.select("family").distinct(), "family", "left_semi")
    met = materialise(_shared_shingles(left))
    first = met.groupBy("family", "shingle").agg(F.min("node").alias("a"))
    stars = met.join(first, ["family", "shingle"]).select("a", F.col("node").alias("b")).where("a < b").distinct()
    stars = stars.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b").where("root_a <> root_b").select("a", "b")
    links = materialise(links.union(_checked(materialise(stars.union(_core_pairs(left, roots)).distinct()), left)))
    roots = _rooted(nodes, links)
    if roots.isEmpty():
        return links
    met = materialise(met.join(roots.select("node", "root"), "node").join(nodes.select("node", "size"), "node"))
    opened = met.groupBy("family", "shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    met = met.join(opened.select("family", "shingle"), ["family", "shingle"])
    one = met.select("family", "shingle", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"))
    two = met.select("family", "shingle", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"))
    fits = f"size_a * {SHARE[1]} >= size_b * {SHARE[0]} and size_b * {SHARE[1]} >= size_a * {SHARE[0]}"
    rest = materialise(one.join(two, ["family", "shingle"]).where(f"a < b and root_a <> root_b and {fits}").select("a", "b").distinct())
    return links if rest.isEmpty() else materialise(links.union(_checked(rest, nodes)))


def _met_elsewhere(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(a, b)`` of nodes with shingles whose rows share a ``root`` in ``candidates``, each with the smallest such node."""
    theirs = candidates.select(F.col("key").alias("k"), F.col("copy").alias("c"), "root").distinct()
    rows = own.where(F.size("bands") > 0).select("key", "copy", "node").distinct()
    met = rows.join(theirs, F.col("key").eqNullSafe(F.col("k")) & (F.col("copy") == F.col("c"))).select("root", "node")
    met = materialise(met.distinct())
    return met.join(met.groupBy("root").agg(F.min("node").alias("a")), "root").where("a < node").select("a", F.col("node").alias("b"))


def _band_stars(own: DataFrame) -> DataFrame:
    """``(a, b)`` of nodes that agree in a band, each with the smallest such node."""
    banded = own.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    return banded.hint("merge").join(shared, "band").where("a < node").select("a", F.col("node").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", candidates: DataFrame | None = None) -> DataFrame:
    """``(key, copy, node, root)`` of every row; rows of one ``root`` are near-duplicates.

    Rows of one ``root`` of ``candidates`` (``key, copy, root`` of every row, found in another way) are of one family as well.
    """
    own = materialise(_signed(docs, key, text))
    stars = _band_stars(own)
    if candidates is not None:
        stars = stars.union(_met_elsewhere(own, candidates))
    families = materialise(components(materialise(stars)).select("node", F.col("root").alias("family")))
    own = own.drop("bands")
    rooted = components(links_of(docs, own, families, key, text))
    return own.join(rooted, "node", "left").select("key", "copy", "node", F.coalesce("root", "node").alias("root"))


def first_rows(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each ``root`` of ``found`` (``key, copy, root``): that of the smallest key, then text hash.

    Rows without a key all stay.
    """
    named = found.where(F.col("key").isNotNull()).groupBy("root", "key", "copy").agg(F.count("*").alias("n"))
    named = materialise(named)
    least = named.groupBy("root").agg(F.min(F.struct("key", "copy")).alias("kept"))
    judged = named.join(least, "root").select("key", "copy", "n", (F.struct("key", "copy") == F.col("kept")).alias("stays"))
    chosen = materialise(judged.where("not stays or n > 1"))  # rows that go, and repeats of rows that stay
    if chosen.isEmpty():
        return docs
    met = marked(docs, chosen, key, text)
    calm = met.where("not hit").select("row.*")
    touched = met.where("hit")
    same = touched.join(chosen, ["key", "copy"], "left_anti").select("row.*")
    left = calm.union(same)
    again = chosen.where("stays")
    if again.isEmpty():
        return left
    return left.union(touched.join(again, ["key", "copy"], "left_semi").dropDuplicates(["key", "copy"]).select("row.*"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", candidates: DataFrame | None = None) -> DataFrame:
    """One row of each group: that of the smallest key; rows without a key all stay.

    ``candidates``: see ``groups``.
    """
    return first_rows(docs, materialise(groups(docs, key, text, candidates)), key, text)
