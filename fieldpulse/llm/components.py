"""Connected components of links between 64-bit keys, without collecting any of them.

Large-star and small-star steps in turn: every node hands the nodes above it (then: below
it) to the smallest node it knows.  Each step is one aggregate and one join, so a node with
many links is pre-aggregated and its rows can be split; links only ever become fewer.  Rounds
grow with the logarithm of the longest chain; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise

MAX_ROUNDS = 100


def _written(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The materialised links and their checksum, taken while they are written."""
    seen = Observation()
    table = materialise(links.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return table, (seen.get["n"], seen.get["x"])


def _large_star(links: DataFrame) -> DataFrame:
    """``links``: distinct ``(a, b)`` with ``a < b``.  Larger neighbours move to the smallest one; links may repeat then."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("of")), F.struct(F.col("b").alias("n"), F.col("a").alias("of"))))
    least = links.select(ends.alias("x")).groupBy(F.col("x.n").alias("a")).agg(F.min("x.of").alias("m"))
    return links.join(least, "a").select(F.least("m", "a").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours and the node itself move to the smallest one."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))
    return links.join(least, "b").select(moved.alias("x")).select("x.a", "x.b").where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with a link; the root is the smallest node of its component.

    ``links`` has two bigint columns ``a`` and ``b``; direction, repeats and loops don't matter.
    """
    now, before = _written(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(MAX_ROUNDS):
        now, after = _written(_small_star(_large_star(now)))
        if after == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
