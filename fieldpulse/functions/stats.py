"""Ratios, min-max scaling, exact percentiles and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null when b is zero (the session runs in ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo), 0 when the range is empty."""
    return F.coalesce(F.when(hi > lo, F.try_divide(x - lo, hi - lo)), F.lit(0.0))


def with_scalar(df: DataFrame, name: str, one: DataFrame) -> DataFrame:
    """Add the single value of the one-row frame ``one`` as a column.

    The value is a scalar subquery, computed once; later expressions refer to
    the column, so the subquery is not repeated in the plan.
    """
    return df.withColumn(name, one.scalar())


def minmax(df: DataFrame, cols: list[str], prefix: str = "norm_") -> DataFrame:
    """Add ``prefix + col``: each column min-max scaled over the whole frame.

    The bounds are a one-row aggregate read as a scalar subquery.
    """
    bounds = df.agg(F.struct(*[
        f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))
    ]).alias("b"))
    at = F.col("_bounds")
    return with_scalar(df, "_bounds", bounds).withColumns({
        prefix + c: scaled(F.col(c), at[f"lo_{c}"], at[f"hi_{c}"]) for c in cols
    }).drop("_bounds")


def exact_percentiles(df: DataFrame, col: str, probs: list[float], accuracy: int = 1000) -> DataFrame:
    """One row with interpolated percentiles ``p0, p1, ...`` of ``col``, computed exactly.

    Two passes, each with a bounded final task.  The first brackets every
    percentile with approximate ones of known rank error.  The second maps all
    values outside the brackets to a bracket edge by a monotone rule, so equal
    ranks keep equal values where they matter, and only a small part of the
    distinct values reaches the exact aggregate.  Frames of up to
    ``10 * accuracy`` rows need no bracket and keep every value.
    """
    margin = 2.0 / accuracy
    order = sorted(set(probs))
    edges = [float(min(1.0, max(0.0, p + side * margin))) for p in order for side in (-1, 1)]
    bracket = df.agg(F.struct(
        F.percentile_approx(col, edges, accuracy).alias("edge"), F.count(col).alias("n"),
    ).alias("m"))
    x, marks = F.col(col), F.col("_marks")
    value = F.when(marks["n"] <= 10 * accuracy, x)
    for i in range(len(order)):
        lo, hi = marks["edge"][2 * i], marks["edge"][2 * i + 1]
        below = lo if i == 0 else F.least(marks["edge"][2 * i - 1], lo)
        value = value.when(x < lo, below).when(x <= hi, x)
    value = value.otherwise(marks["edge"][2 * len(order) - 1])
    known = with_scalar(df.where(x.isNotNull()), "_marks", bracket)
    counts = known.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(*[
        F.percentile("v", p, F.col("n")).alias(f"p{i}") for i, p in enumerate(probs)
    ])


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null when either series is constant."""
    cov = n * sxy - sx * sy
    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(var > 0, F.try_divide(cov, F.sqrt(var)))
