"""Topic evolution: counts, share, growth and momentum per topic and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import dealt
from ..functions.stats import ratio
from ..session import materialise


def topic_names(work_topics: DataFrame) -> DataFrame:
    """One name per topic: the largest spelling."""
    return work_topics.select("topic_id", "topic_name").distinct().groupBy("topic_id").agg(
        F.max("topic_name").alias("topic_name"))


def topic_works(works: DataFrame, work_topics: DataFrame, years: tuple[int, int] | None = None,
                subfield_id: str | None = None, keep_undated: bool = False) -> DataFrame:
    """One row per (work, topic): year, citations and the number of tag rows.

    The tags are counted before the join.  Those of a large table are dealt out for it, and the counts for the join, in
    shares that do not grow with the table; in a small one repeated tags and works with many tag rows collapse on the
    map side.  ``works`` holds one row per work.
    """
    tags = work_topics if subfield_id is None else work_topics.where(F.col("subfield_id") == subfield_id)
    pair, rows = ["work_id", "topic_id"], tags.count()
    tags = dealt(tags.select(*pair), pair, rows).groupBy(*pair).agg(F.count("*").alias("tag_rows"))
    dated = works.select(
        "work_id", F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))
    if years is not None:
        dated = dated.where(F.col("year").between(*years))
    elif not keep_undated:
        dated = dated.where(F.col("year").isNotNull())
    return dealt(tags, "work_id", rows).join(dealt(dated, "work_id", rows), "work_id")


def topic_year_counts(tagged: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct works and citation sum per topic and year, from ``topic_works`` and ``topic_names``.

    The count is over distinct works; the citation sum counts every tag row.
    """
    return tagged.groupBy("topic_id", "year").agg(
        F.count("*").cast("int").alias("work_count"),
        F.sum(F.col("cited_by_count") * F.col("tag_rows")).alias("citation_sum"),
    ).join(names, "topic_id")


def merge_counts(seed: DataFrame, computed: DataFrame) -> DataFrame:
    """Upsert by (topic, year): computed rows replace seed rows, seed-only rows stay."""
    both = seed.select(
        "topic_id", "year", F.lit(0).alias("pri"), "topic_name", "work_count",
        F.lit(0).cast("long").alias("citation_sum"),
    ).unionByName(computed.select(
        "topic_id", "year", F.lit(1).alias("pri"), "topic_name", "work_count", "citation_sum"))
    best = F.max_by(F.struct("topic_name", "work_count", "citation_sum"),
                    F.struct("pri", "work_count"))
    return both.groupBy("topic_id", "year").agg(best.alias("r")).select(
        "topic_id", "year", "r.topic_name", "r.work_count", "r.citation_sum")


def relative_share(counts: DataFrame) -> DataFrame:
    """Add each topic's share of the year's total; 0 when the total is 0."""
    totals = counts.groupBy("year").agg(F.sum("work_count").alias("total"))
    return counts.join(totals, "year").withColumn(
        "relative_share", F.coalesce(ratio(F.col("work_count"), F.col("total")), F.lit(0.0))
    ).drop("total")


def _topic_years(first: int, last: int):
    return Window.partitionBy("topic_id").orderBy("year").rangeBetween(first, last)


def growth_rate(counts: DataFrame) -> DataFrame:
    """Add growth against exactly the year before; 0 when that is missing or 0."""
    prior = F.max("work_count").over(_topic_years(-1, -1))
    return counts.withColumn("growth_rate", F.coalesce(
        F.when(prior > 0, ratio(F.col("work_count") - prior, prior)), F.lit(0.0)))


def momentum(growth: DataFrame, window: int = 3) -> DataFrame:
    """Add the mean growth over the rows of the last ``window`` years."""
    return growth.withColumn("momentum", F.avg("growth_rate").over(_topic_years(1 - window, 0)))


def topic_year_stats(works: DataFrame, work_topics: DataFrame, seed: DataFrame | None = None,
                     years: tuple[int, int] | None = None, window: int = 3) -> DataFrame:
    """The topic-year table; ``seed`` supplies counts for topic-years without loaded works."""
    counts = topic_year_counts(topic_works(works, work_topics, years), topic_names(work_topics))
    return stats_from_counts(counts if seed is None else merge_counts(seed, counts), window)


def stats_from_counts(counts: DataFrame, window: int = 3) -> DataFrame:
    """Share, growth and momentum on top of topic-year counts.

    The counts are read twice, for the rows and for the yearly totals.  They are a
    small table at the end of the heaviest join, so they are written once.
    """
    full = momentum(growth_rate(relative_share(materialise(counts))), window)
    return full.select(
        "topic_id", "topic_name", "year", "work_count", "citation_sum", "growth_rate",
        "relative_share", "momentum", F.lit(False).alias("is_emerging"))


def add_counts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts after an append: ``fresh`` are the counts of works that ``stored`` does not hold yet."""
    both = stored.select("topic_id", "topic_name", "year", "work_count", "citation_sum").unionByName(
        fresh.select("topic_id", "topic_name", "year", "work_count", "citation_sum"))
    return both.groupBy("topic_id", "year").agg(
        F.sum("work_count").cast("int").alias("work_count"), F.sum("citation_sum").alias("citation_sum"),
    ).join(topic_names(both), "topic_id")


def touched_years(stored: DataFrame, fresh: DataFrame, window: int = 3) -> list[int]:
    """Years whose rows an append changes.

    Share and growth of a year follow from its counts, growth also from the year before, and momentum
    from ``window`` growths; a topic with a new name changes in all its years.
    """
    years = fresh.select(F.explode(F.sequence("year", F.col("year") + window)).alias("year"))
    renamed = topic_names(fresh).join(topic_names(stored).withColumnRenamed("topic_name", "old"), "topic_id").where(
        "topic_name > old")
    again = stored.join(renamed.select("topic_id"), "topic_id", "left_semi").select("year")
    return sorted(r["year"] for r in years.union(again).distinct().collect())  # a row per year


def refreshed_years(stored: DataFrame, fresh: DataFrame, window: int = 3) -> DataFrame:
    """The rows of all touched years after an append, from the stored table and the counts of new works.

    Only stored years that these rows depend on are counted again; no stored work is read.
    """
    years = touched_years(stored, fresh, window)
    needed = sorted({y - back for y in years for back in range(window + 1)})
    # names come from all years of a topic, counts from the needed ones
    counts = add_counts(stored, fresh).where(F.col("year").isin(needed))
    return stats_from_counts(counts, window).where(F.col("year").isin(years))


def updated_rows(stats: DataFrame) -> DataFrame:
    """How many topic-years have a growth other than 0."""
    return stats.agg(F.count_if(F.col("growth_rate") != 0).alias("updated_rows"))
