"""Queries behind an exploration screen: series, heat map, flows and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shorten
from ..functions.stats import with_scalar
from .transitions import neighbour_year, observed_years

# List lengths of the views.
SERIES_TOPICS, HEATMAP_TOPICS, HEATMAP_YEARS, FLOW_TOPICS = 15, 20, 5, 10
EVIDENCE_ROWS, EVIDENCE_TOPICS, EVIDENCE_AUTHORS = 100, 3, 5
LABEL_LENGTH = 28


def top_by_works(stats: DataFrame, n: int, selected: list[str] | None = None) -> DataFrame:
    """Ids of the ``n`` topics with the largest total count, among the selected ones if given."""
    rows = stats.where(F.col("topic_id").isin(selected)) if selected else stats
    return rows.groupBy("topic_id").agg(F.sum("work_count").alias("total")).orderBy(
        F.desc("total"), "topic_id").limit(n)


def trend_series(stats: DataFrame, y: str = "work_count", selected: list[str] | None = None,
                 top: int = SERIES_TOPICS) -> DataFrame:
    """The yearly series of the selected or the top topics, with an any-year emerging flag."""
    if selected:
        rows = stats.where(F.col("topic_id").isin(selected))
    else:
        rows = stats.join(F.broadcast(top_by_works(stats, top).select("topic_id")), "topic_id", "left_semi")
    ever = F.max("is_emerging").over(Window.partitionBy("topic_id"))
    return rows.select("topic_id", "topic_name", "year", F.col(y).alias("y"), "growth_rate", "momentum",
                       ever.alias("ever_emerging"))


def emerging_heatmap(signals: DataFrame, years: int = HEATMAP_YEARS, top: int = HEATMAP_TOPICS) -> DataFrame:
    """Topic by year scores of the last years: column ``back_i`` is ``i`` years before the last."""
    last = F.col("last_year")
    recent = with_scalar(signals, "last_year", signals.agg(F.max("year"))).where(F.col("year") > last - years)
    best = recent.groupBy("topic_id").agg(F.avg("composite_score").alias("m")).orderBy(
        F.desc(F.round("m", 9)), "topic_id").limit(top).select("topic_id")
    cells = [F.max(F.when(F.col("year") == last - i, F.col("composite_score"))).alias(f"back_{i}")
             for i in range(years)]
    return recent.join(F.broadcast(best), "topic_id", "left_semi").groupBy("topic_id").agg(
        F.max("topic_name").alias("topic_name"), F.max(last).alias("last_year"), *cells)


def emerging_ranked(signals: DataFrame, year: int | None = None) -> DataFrame:
    """One year's signals (the latest by default), best score first."""
    target = signals.agg(F.max("year")).scalar() if year is None else F.lit(year)
    return signals.where(F.col("year") == target).select(
        "topic_id", "topic_name", "classification", "composite_score", "acceleration",
        "new_author_fraction", "cross_topic_score").orderBy(F.desc("composite_score"), "topic_id")


def evidence_for_year(papers: DataFrame, signals: DataFrame, year: int | None = None) -> DataFrame:
    """The linked papers of one year (the latest signal year by default)."""
    target = signals.agg(F.max("year")).scalar() if year is None else F.lit(year)
    return papers.where(F.col("year") == target)


def flow_nodes(stats: DataFrame, top: int = FLOW_TOPICS, selected: list[str] | None = None) -> DataFrame:
    """One node per present (topic, year) of the flow topics, numbered by year, then topic rank.

    Nothing is shown when fewer than two years remain.
    """
    chosen = top_by_works(stats, top, selected)
    ordered = chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("total")).alias("t"), "topic_id"))), lambda s: s["topic_id"]).alias("ids"))
    rows = stats.join(F.broadcast(chosen.select("topic_id")), "topic_id", "left_semi")
    rows = with_scalar(rows, "_ids", ordered).withColumn(
        "_key", F.struct("year", F.array_position("_ids", F.col("topic_id")).alias("rank")))
    # Nodes are at most top x years, so their keys fit one sorted array.
    rows = with_scalar(rows, "_keys", rows.agg(F.array_sort(F.collect_list("_key")).alias("k")))
    years = F.array_distinct(F.transform("_keys", lambda k: k["year"]))
    index = F.array_position("_keys", F.col("_key")) - 1
    label = F.concat(shorten("topic_name", LABEL_LENGTH), F.lit(" '"),
                     F.substring(F.col("year").cast("string"), 3, 100))
    return rows.where(F.size(years) >= 2).select(
        index.cast("int").alias("node"), "topic_id", "year", "work_count", label.alias("label"))


def flow_links(nodes: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Links between nodes: topics that continue, and transitions by shared authors."""
    ahead = nodes.select(F.col("topic_id").alias("to_topic"), F.col("year").alias("to_year"),
                         F.col("node").alias("target"), F.col("work_count").alias("to_count"))
    start = neighbour_year(nodes, observed_years(nodes), 1, "next_year").where(F.col("next_year").isNotNull())
    links = start.join(ahead, (start.topic_id == ahead.to_topic) & (start.next_year == ahead.to_year)).select(
        F.col("node").alias("source"), "target",
        F.least("work_count", "to_count").cast("int").alias("value"), F.lit("continues").alias("kind")
    ).where(F.col("value") > 0)
    if transitions is None:
        return links
    src = nodes.select(F.col("topic_id").alias("src_topic_id"), "year", F.col("node").alias("source"))
    tgt = nodes.select(F.col("topic_id").alias("tgt_topic_id"), F.col("year").alias("next_year"),
                       F.col("node").alias("target"))
    moved = transitions.where(F.col("overlap_count") != 0).join(src, ["src_topic_id", "year"]).join(
        tgt, ["tgt_topic_id", "next_year"]).select(
        "source", "target", F.col("overlap_count").alias("value"), F.col("transition_type").alias("kind"))
    return links.unionByName(moved)


def _first_names(rows: DataFrame, name: str, order: list[Column], k: int, out: str) -> DataFrame:
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("work_id").orderBy(*order))).where(
        F.col("r") <= k)
    return ranked.groupBy("work_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("r", F.col(name).alias("name")))), lambda s: s["name"]),
        "; ").alias(out))


def evidence_works(works: DataFrame, work_topics: DataFrame, authorships: DataFrame,
                   topics: list[str] | None = None, authors: list[str] | None = None,
                   years: tuple[int, int] | None = None, query: str = "", n: int = EVIDENCE_ROWS,
                   regex: bool = False) -> DataFrame:
    """The most cited works that pass all filters; the title match ignores case."""
    rows = works
    if years is not None:
        rows = rows.where(F.col("publication_year").between(*years))
    if topics:
        rows = rows.join(work_topics.where(F.col("topic_id").isin(topics)).select("work_id").distinct(),
                         "work_id", "left_semi")
    if authors:
        rows = rows.join(authorships.where(F.col("author_id").isin(authors)).select("work_id").distinct(),
                         "work_id", "left_semi")
    if query:
        title = F.coalesce("title", F.lit(""))
        rows = rows.where(title.rlike("(?i)" + query) if regex
                          else F.contains(F.lower(title), F.lit(query.lower())))
    return rows.orderBy(F.desc("cited_by_count"), "work_id").limit(n)


def evidence_table(chosen: DataFrame, work_topics: DataFrame, authorships: DataFrame) -> DataFrame:
    """Display rows: the first topics by score and the first authors by position.

    ``chosen`` is the limited result of ``evidence_works``; its ids are broadcast.
    """
    ids = F.broadcast(chosen.select("work_id"))
    topics = _first_names(
        work_topics.join(ids, "work_id", "left_semi"), "topic_name",
        [F.desc("score"), F.asc("topic_id")], EVIDENCE_TOPICS, "topics")
    place = F.array_position(F.array(F.lit("first"), F.lit("middle"), F.lit("last")),
                             F.col("author_position"))
    authors = _first_names(
        authorships.join(ids, "work_id", "left_semi"), "author_name",
        [F.asc(place), F.asc("author_id")], EVIDENCE_AUTHORS, "authors")
    return chosen.join(topics, "work_id", "left").join(authors, "work_id", "left").select(
        "work_id", "title", F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("citations"), "topics", "authors",
    ).orderBy(F.desc("citations"), "work_id")


def topic_label(stats: DataFrame, selected: list[str] | None) -> DataFrame:
    """The name of the selected topic when exactly one is selected, else no row."""
    rows = stats.where(F.col("topic_id").isin(selected or []))
    if not selected or len(selected) != 1:
        rows = rows.limit(0)
    return rows.groupBy("topic_id").agg(F.max("topic_name").alias("topic_name"))


def effective_selection(selected: list[str] | None, clicked: str | None) -> list[str] | None:
    """A click on one element replaces the selection."""
    return [clicked] if clicked else selected
