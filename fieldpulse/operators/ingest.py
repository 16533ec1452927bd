"""Nested work records to the four flat tables, and dictionaries derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import extract_id, reconstruct_abstract
from ..session import materialise
from ..sources.works import select_works

#: Texts whose indexes are handed on at once.
INDEX_ROWS = 256


def _indexed_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, abstract_inverted_index)`` of every row, each indexed where it lies."""
    kind = texts.schema[key].dataType.simpleString()
    places = pa.map_(pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), INDEX_ROWS):
                part, indexes = batch.slice(start, INDEX_ROWS), []
                for words in part.column(1).to_pylist():
                    index: dict[str, list[int]] = {}
                    for at, word in enumerate(words or ()):
                        if word:
                            index.setdefault(word, []).append(at)
                    indexes.append(list(index.items()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(indexes, places)], [key, "abstract_inverted_index"])

    return texts.select(key, _split_words(text).alias("_words")).mapInArrow(
        run, f"`{key}` {kind}, abstract_inverted_index map<string,array<int>>")


def _split_words(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")


def build_inverted_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, abstract_inverted_index)``, one row per key: each word of its text with its positions.

    A text that has its key alone is indexed where it lies.  Only keys are counted over all rows, and only texts of
    a repeated key are dealt out by key.
    """
    repeated = materialise(texts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    single = _indexed_texts(texts.join(repeated, same, "left_anti"), key, text)
    words = texts.join(repeated, same, "left_semi").select(key, F.posexplode_outer(_split_words(text)).alias("pos", "word"))
    places = words.groupBy(key, "word").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    entries = F.collect_list(F.when(F.col("word") != "", F.struct("word", "at")))
    return single.unionByName(places.groupBy(key).agg(F.map_from_entries(entries).alias("abstract_inverted_index")))


def dedupe_works(raw: DataFrame) -> DataFrame:
    """Records with an id, the first delivery of each work.

    Order of delivery is ``ingest_seq``, which the readers set from the file time, the
    file and the place in it; without it the scalar fields decide, then a hash of the whole record.
    The rank is limited on the map side, so copies of one work do not pile up.
    """
    order = ["ingest_seq"] if "ingest_seq" in raw.columns else []
    order += ["display_name", "publication_year", "cited_by_count", F.xxhash64(F.to_json(F.struct("*")))]
    first = Window.partitionBy("work_id").orderBy(*order)
    return (
        raw.withColumn("work_id", extract_id("id")).where(F.col("work_id") != "")
        .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank"))


def keyed_works(raw: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Records with their work id: survivors of the de-duplication, or every record."""
    if not keep_duplicates:
        return dedupe_works(raw)
    return raw.withColumn("work_id", extract_id("id")).where(F.col("work_id") != "")


def works_table(records: DataFrame) -> DataFrame:
    """Scalar columns with defaults, the abstract and the primary topic."""
    primary = F.try_element_at("topics", F.lit(1))
    return records.select(
        "work_id", F.coalesce("display_name", F.lit("")).alias("title"), "publication_year",
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        reconstruct_abstract("abstract_inverted_index").alias("abstract_text"),
        F.when(primary.isNotNull(), extract_id(primary["id"])).alias("primary_topic_id"))


def work_topics_table(records: DataFrame) -> DataFrame:
    """One row per (work, topic) tag."""
    return records.select("work_id", F.explode("topics").alias("t")).select(
        "work_id", extract_id(F.col("t.id")).alias("topic_id"),
        F.coalesce("t.display_name", F.lit("")).alias("topic_name"),
        F.coalesce("t.score", F.lit(0.0)).alias("score"),
        extract_id(F.col("t.subfield.id")).alias("subfield_id"))


def authorships_table(records: DataFrame) -> DataFrame:
    """One row per authorship, with the first institution only."""
    place = F.try_element_at(F.col("a.institutions"), F.lit(1))
    return records.select("work_id", F.explode("authorships").alias("a")).select(
        "work_id", extract_id(F.col("a.author.id")).alias("author_id"),
        F.coalesce("a.author.display_name", F.lit("")).alias("author_name"),
        F.coalesce("a.author_position", F.lit("")).alias("author_position"),
        extract_id(place["id"]).alias("institution_id"),
        F.coalesce(place["display_name"], F.lit("")).alias("institution_name"))


def citations_table(records: DataFrame) -> DataFrame:
    """One row per referenced work."""
    return records.select("work_id", F.explode("referenced_works").alias("ref")).select(
        "work_id", extract_id(F.col("ref")).alias("referenced_work_id"))


def flat_tables(raw: DataFrame, keep_duplicates: bool = False) -> dict[str, DataFrame]:
    """The four tables; child rows come from surviving works only.

    With ``keep_duplicates`` child rows of every delivery are kept, works stay unique.
    """
    survivors = materialise(keyed_works(raw))  # chosen once: all four tables see the same copies
    source = keyed_works(raw, True) if keep_duplicates else survivors
    return {
        "works": works_table(survivors), "work_topics": work_topics_table(source),
        "authorships": authorships_table(source), "citations": citations_table(source)}


def seed_topic_year_counts(raw: DataFrame, **selection) -> DataFrame:
    """Distinct selected works per topic and year, straight from the nested records.

    ``selection`` is passed to ``select_works``.  Metrics that are computed later
    start at zero.
    """
    tags = select_works(raw, **selection).select(
        extract_id("id").alias("work_id"), F.col("publication_year").alias("year"),
        F.explode("topics").alias("t"))
    distinct = tags.where(F.col("work_id") != "").groupBy(
        extract_id(F.col("t.id")).alias("topic_id"), "year", "work_id",
    ).agg(F.max("t.display_name").alias("topic_name"))
    zero = F.lit(0.0)
    return distinct.groupBy("topic_id", "year").agg(
        F.max("topic_name").alias("topic_name"), F.count("*").cast("int").alias("work_count"),
    ).select("topic_id", "topic_name", "year", "work_count",
             F.lit(0).cast("long").alias("citation_sum"), zero.alias("growth_rate"),
             zero.alias("relative_share"), zero.alias("momentum"), F.lit(False).alias("is_emerging"))


def topics_meta(work_topics: DataFrame) -> DataFrame:
    """The topic dictionary with distinct works; the tables carry no subfield names."""
    per_work = work_topics.groupBy("topic_id", "work_id").agg(
        F.max("topic_name").alias("name"), F.max("subfield_id").alias("sub"))
    return per_work.groupBy("topic_id").agg(
        F.max("name").alias("display_name"), F.max("sub").alias("subfield_id"),
        F.count("*").cast("int").alias("works_count"),
    ).select("topic_id", "display_name", "subfield_id",
             F.lit(None).cast("string").alias("subfield_name"), "works_count")


def topic_options(stats: DataFrame) -> DataFrame:
    """Distinct topics for a selection list, by name."""
    return stats.select("topic_id", "topic_name").distinct().orderBy("topic_name", "topic_id")
