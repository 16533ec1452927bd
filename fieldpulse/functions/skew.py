"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise

#: Rows of one key that a single task may join without being split.
ROWS_PER_PART = 2_000
#: Rows that a task of an even join takes from its left side, whatever the size of the table.
ROWS_PER_TASK = 500_000


def hot_keys(df: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(key, parts)`` of all keys above ``rows_per_part`` rows.

    Their number is at most the rows of ``df`` over ``rows_per_part``; whether the list is small enough
    to broadcast is left to the planner.  Keys that are not listed are joined in one part.
    """
    return (
        df.groupBy(key).agg(F.count("*").alias("n"))
        .where(F.col("n") > rows_per_part)
        .select(key, F.ceil(F.col("n") / rows_per_part).cast("int").alias("parts"))
    )


def measured(df: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> tuple[bool, int]:
    """Whether a key has over ``rows_per_part`` rows, and the number of all rows; the keys are counted in even shares."""
    rows = df.count()
    seen = Observation()
    counted = dealt(df.select(key), key, rows).groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    counted.observe(seen, F.max("most").alias("most")).write.format("noop").mode("overwrite").save()
    return (seen.get["most"] or 0) > rows_per_part, rows


def joined_rows(left: DataFrame, right: DataFrame, key: str, rows: int) -> int:
    """Rows of the join of both sides, from the counts of every key; ``left`` has ``rows`` rows."""
    a, b = (dealt(df.select(key), key, rows).groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "a"), (right, "b")))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def dealt(df: DataFrame, key: str | list[str], rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt out by ``key`` for a table of ``rows`` rows, so that no task grows with the table; small ones as they are."""
    parts = -(-rows // rows_per_task)
    keys = [key] if isinstance(key, str) else key
    return df if parts <= 1 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def split_join(left: DataFrame, right: DataFrame, key: str, salt_by: str,
               rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Inner many-to-many join on ``key``; ``left`` rows of a hot key are spread by ``salt_by``.

    Rows of ``right`` are repeated once per part, for hot keys only.
    """
    hot = hot_keys(left, key, rows_per_part)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    salted = (
        left.join(hot, key, "left")
        .withColumn("part", F.pmod(F.xxhash64(salt_by), parts).cast("int")).drop("parts")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    )
    return salted.join(repeated, [key, "part"]).drop("part")


def distinct_pairs(df: DataFrame, key: str, member: str,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """All ``(key, a, b)`` with ``a < b`` for members sharing a key; ``df`` is distinct.

    The pairs are the result itself, so their number cannot shrink; what is
    split is the work of one hot key: its members fall into blocks and every
    pair of blocks is a join key of its own.  Without a hot key both sides are dealt out once.
    """
    df = materialise(df)  # read for its sizes and for the pairs
    split, rows = measured(df, key, rows_per_part)
    if not split:
        df = dealt(df, key, rows)
        return df.select(key, F.col(member).alias("a")).join(df.select(key, F.col(member).alias("b")), key).where("a < b")
    hot = hot_keys(df, key, rows_per_part)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    blocked = (
        df.join(hot, key, "left")
        .withColumn("parts", parts)
        .withColumn("blk", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    )
    first = blocked.select(
        key, F.col(member).alias("a"), F.col("blk").alias("i"),
        F.explode(F.sequence(F.col("blk"), F.col("parts") - 1)).alias("j"))
    second = blocked.select(
        key, F.col(member).alias("b"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"),
        F.col("blk").alias("j"))
    met = first.join(second, [key, "i", "j"]).where(
        (F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return met.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
