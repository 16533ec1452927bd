"""Emerging-topic detector: three signals, a score, a class and the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import dealt, joined_rows, measured, split_join
from ..functions.stats import exact_percentiles, minmax, ratio, with_scalar
from ..session import materialise
from .evolution import stats_from_counts, topic_names, topic_works, topic_year_counts

# Score weights and the number of papers linked per topic-year.
WEIGHTS = (0.4, 0.3, 0.3)
TOP_PAPERS = 5

SIGNALS = ("acceleration", "new_author_fraction", "cross_topic_score")
#: Authors of a topic-year, those who appear in the topic for the first time, those with no other topic that year.
COUNTS = ("authors", "fresh", "single")


def acceleration(stats: DataFrame) -> DataFrame:
    """Growth minus the growth of exactly the year before (0 without that row)."""
    before = Window.partitionBy("topic_id").orderBy("year").rangeBetween(-1, -1)
    change = F.col("growth_rate") - F.max("growth_rate").over(before)
    return stats.withColumn("acceleration", F.coalesce(change, F.lit(0.0))).where(
        F.col("work_count") > 0).select("topic_id", "topic_name", "year", "acceleration")


def work_authors(authorships: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Distinct (work, author); blank authors are left out unless asked for."""
    rows = authorships if keep_blank else authorships.where(F.col("author_id") != "")
    return rows.select("work_id", "author_id").distinct()


def topic_author_year(tagged: DataFrame, authorships: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Distinct (topic, author, year), from ``topic_works`` and authorships.

    A work with very many authors is split over several tasks.  Without one, both sides are dealt out by work
    once, in shares that do not grow with the tables, and repeated authors go where they meet.  What they make is
    counted first, from the rows of every work, and its distinct rows are found in such shares as well.
    """
    tags = tagged.select("work_id", "topic_id", "year")
    people = authorships if keep_blank else authorships.where(F.col("author_id") != "")
    people = people.select("work_id", "author_id")
    split, rows = measured(people, "work_id")
    if split:
        met = split_join(work_authors(authorships, keep_blank), tags, "work_id", "author_id")
    else:
        met = dealt(people, "work_id", rows).distinct().join(dealt(tags, "work_id", rows), "work_id")
    triple = ["topic_id", "author_id", "year"]
    return dealt(met.select(*triple), triple, joined_rows(people, tags, "work_id", rows)).distinct()


def author_first_year(tay: DataFrame) -> DataFrame:
    """The first year of each author in each topic."""
    return tay.groupBy("topic_id", "author_id").agg(F.min("year").alias("first_year"))


def author_topic_breadth(tay: DataFrame) -> DataFrame:
    """How many topics each author has in each year."""
    return tay.groupBy("author_id", "year").agg(F.count("*").alias("n_topics"))


def author_counts(tay: DataFrame) -> DataFrame:
    """The ``COUNTS`` per topic-year; each is a sum over authors.

    The rows are dealt out by author once for both groupings, in shares that do not grow with the table; an author has at
    most topics times years of them.
    """
    per_author = dealt(tay.select("topic_id", "author_id", "year").repartition("author_id"), "author_id", tay.count())
    one = F.lit(1)
    zero = F.lit(0)
    everyone = tay.groupBy("topic_id", "year").agg(F.count("*").alias("authors")).select(
        "topic_id", "year", "authors", zero.alias("fresh"), zero.alias("single"))
    fresh = author_first_year(per_author).groupBy(
        "topic_id", F.col("first_year").alias("year")).agg(F.count("*").alias("fresh")).select(
        "topic_id", "year", zero.alias("authors"), "fresh", zero.alias("single"))
    single = (
        per_author.groupBy("author_id", "year")
        .agg(F.count("*").alias("n_topics"), F.min("topic_id").alias("topic_id"))
        .where(F.col("n_topics") == one)
        .groupBy("topic_id", "year").agg(F.count("*").alias("single"))
        .select("topic_id", "year", zero.alias("authors"), zero.alias("fresh"), "single"))
    return everyone.unionByName(fresh).unionByName(single).groupBy("topic_id", "year").agg(
        *[F.sum(c).alias(c) for c in COUNTS])


def signal_ratios(counts: DataFrame) -> DataFrame:
    """Both author signals from the counts."""
    return counts.select(
        "topic_id", "year",
        ratio(F.col("fresh"), F.col("authors")).alias("new_author_fraction"),
        ratio(F.col("authors") - F.col("single"), F.col("authors")).alias("cross_topic_score"))


def author_signals(tay: DataFrame) -> DataFrame:
    """Both author signals per topic-year.

    ``new_author_fraction`` is the share of a topic-year's authors whose first
    year in the topic it is (1 for every topic in the first year of the data).
    ``cross_topic_score`` is the share who have another topic in the same year.
    Both need only counts: authors, first appearances, and authors with one topic.
    """
    return signal_ratios(author_counts(tay))


def composite_score(signals: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of the signals, each min-max scaled over the whole table."""
    score = sum((F.lit(float(w)) * F.col("norm_" + s) for w, s in zip(weights, SIGNALS)), F.lit(0.0))
    return minmax(signals, list(SIGNALS)).withColumn("composite_score", score).drop(
        *["norm_" + s for s in SIGNALS])


def classify_quartiles(scored: DataFrame) -> DataFrame:
    """At or above the upper quartile emerging, else at or below the lower declining."""
    rounded = F.round("composite_score", 12)
    cuts = exact_percentiles(
        scored.select(rounded.alias("score")), "score", [0.25, 0.75]
    ).select(F.struct(F.round("p0", 12).alias("low"), F.round("p1", 12).alias("high")).alias("c"))
    return with_scalar(scored, "_cuts", cuts).withColumn(
        "classification",
        F.when(rounded >= F.col("_cuts.high"), "emerging")
        .when(rounded <= F.col("_cuts.low"), "declining").otherwise("established")).drop("_cuts")


def topic_signals(stats: DataFrame, tay: DataFrame) -> DataFrame:
    """The three raw signals; author signals are 0 where no authorship exists."""
    return acceleration(stats).join(author_signals(tay), ["topic_id", "year"], "left").select(
        "topic_id", "topic_name", "year", "acceleration",
        F.coalesce("new_author_fraction", F.lit(0.0)).alias("new_author_fraction"),
        F.coalesce("cross_topic_score", F.lit(0.0)).alias("cross_topic_score"))


def emerging_signals(stats: DataFrame, tay: DataFrame,
                     weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """The signal table: raw signals, composite score and class.

    The raw signals are read several times (bounds, percentiles, rows), so the
    topic-year table is written once.
    """
    return classify_quartiles(composite_score(materialise(topic_signals(stats, tay)), weights))


def signals_from_tables(works: DataFrame, work_topics: DataFrame, authorships: DataFrame) -> DataFrame:
    """End to end: base tables to classified topic-years."""
    tagged = materialise(topic_works(works, work_topics))
    return emerging_signals(stats_from_counts(topic_year_counts(tagged, topic_names(work_topics))),
                            materialise(topic_author_year(tagged, authorships)))


def flag_emerging(stats: DataFrame, signals: DataFrame) -> DataFrame:
    """Stats with ``is_emerging`` set from the class; rows without a class keep their flag."""
    marks = signals.select("topic_id", "year", (F.col("classification") == "emerging").alias("hit"))
    return stats.join(marks, ["topic_id", "year"], "left").withColumn(
        "is_emerging", F.coalesce("hit", "is_emerging")).drop("hit").select(*stats.columns)


def representative_papers(signals: DataFrame, tagged: DataFrame, works: DataFrame,
                          k: int = TOP_PAPERS) -> DataFrame:
    """The ``k`` most cited works of every emerging topic-year, ties by work id.

    Every topic-year is ranked first, because the ranking keeps only ``k`` rows per
    task and group before the shuffle; classes and titles join the few rows left.
    """
    chosen = signals.where(F.col("classification") == "emerging").select("topic_id", "year")
    order = Window.partitionBy("topic_id", "year").orderBy(F.desc("cited_by_count"), "work_id")
    best = (
        tagged.select("topic_id", "year", "work_id", "cited_by_count")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    best = best.join(chosen, ["topic_id", "year"], "left_semi")
    return best.join(works.select("work_id", "title"), "work_id").select(
        "topic_id", "year", "work_id", "title", "cited_by_count", "rank")


def emerging_summary(signals: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct emerging topics and the number of linked papers."""
    topics = signals.where(F.col("classification") == "emerging").agg(
        F.countDistinct("topic_id")).scalar()
    return papers.agg(F.count("*").alias("linked_papers")).select(
        topics.alias("emerging_topics"), "linked_papers")
