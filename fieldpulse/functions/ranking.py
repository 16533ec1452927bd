"""Row numbers and long top lists without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Longer top lists are ranked in slices: a plain limit sends this many rows of
#: every partition to one task.
PLAIN_LIMIT = 1_000


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank",
             upto: int | None = None) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` under a total ``order``.

    Rows are range-partitioned by keys and order, so one group may span many
    tasks.  Each slice numbers its own rows and adds the rows of the same group
    in earlier slices.  The ranged rows are written once, because a second
    evaluation could choose other slice borders.  With ``upto`` only the first
    positions are returned, and later slices are not sorted at all.
    """
    cols = df.columns
    ranged = materialise(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    groups = keys or [F.lit(0)]  # without keys: one row per slice
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if upto is not None:
        offsets = offsets.where(F.col("_before") < upto)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    position = F.row_number().over(local) + F.col("_before")
    ranked = ranged.join(offsets, [*keys, "_slice"]).select(*cols, position.cast("long").alias(name))
    return ranked if upto is None else ranked.where(F.col(name) <= upto)


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows under a total order."""
    if n <= PLAIN_LIMIT:
        return df.orderBy(*order).limit(n)
    return numbered(df, [], order, "_position", upto=n).drop("_position")
