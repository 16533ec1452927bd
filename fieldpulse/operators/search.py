"""A stored index over titles: the most cited works whose title holds a text, without reading all titles.

Words are the parts of a lower-case title between white space.  ``postings`` has one row per (word, work) with
the title, in folders by a hash of the word, ordered by word and falling citations; files of a frequent word hold
one stretch of its citations each.  ``words`` has the number of works per word and band of citations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .views import EVIDENCE_ROWS, evidence_works

BUCKETS = 64
#: A text that is part of more words than this is looked for in the titles themselves.
MOST_WORDS = 1_000
#: The first step reads at least this many postings for each row asked for; each further step twice as many.
STEP = 20
_POSTINGS = "word string, work_id string, title string, publication_year int, cited_by_count int, band int, bucket int"
_WORDS = "word string, band int, works long"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _cited() -> Column:
    return F.coalesce("cited_by_count", F.lit(0))


def build_title_index(works: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write ``words`` and ``postings`` of all works with a title.

    ``works`` holds one row per work.  Rows are dealt out by ranges of bucket, word and citations, so a word that a
    third of all titles share fills many files.  The number of buckets is stored in the folder name.
    """
    words = F.array_distinct(F.split(F.lower("title"), r"\s+"))
    postings = works.select(
        F.explode(words).alias("word"), "work_id", "title", "publication_year", "cited_by_count",
        F.floor(F.log2(1 + F.greatest(_cited(), F.lit(0)))).cast("int").alias("band")).where("word <> ''")
    ordered = [F.col("bucket"), F.col("word"), F.desc("band"), F.desc("cited_by_count"), F.col("work_id")]
    postings.withColumn("bucket", _bucket(F.col("word"), buckets)).repartitionByRange(*ordered).sortWithinPartitions(
        *ordered).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings-{buckets}")
    works.sparkSession.read.schema(_POSTINGS).parquet(f"{folder}/postings-{buckets}").groupBy("word", "band").agg(
        F.count("*").alias("works")).write.mode("overwrite").parquet(f"{folder}/words-{buckets}")


def matching_words(spark: SparkSession, folder: str, query: str, buckets: int = BUCKETS) -> list[str] | None:
    """The words that hold the longest part of ``query``; None if they are too many or the query has no part.

    A title that holds the query holds this part within one of its words, so no other word need be read.
    """
    part = max(re.split(r"[ \t\n\x0b\f\r]+", query.lower()), key=len)
    if not part:
        return None
    found = spark.read.schema(_WORDS).parquet(f"{folder}/words-{buckets}").where(F.contains("word", F.lit(part))).select(
        "word").distinct().limit(MOST_WORDS + 1).collect()
    return None if len(found) > MOST_WORDS else [r.word for r in found]


def band_steps(sizes: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Falling stretches of bands ``(lowest, highest)`` from ``(band, works)``, each of about twice the works."""
    steps, held, top, want = [], 0, None, n * STEP
    for band, works in sorted(sizes, reverse=True):
        top, held = band if top is None else top, held + works
        if held >= want:
            steps.append((band, top))
            held, top, want = 0, None, want * 2
    return steps if top is None else [*steps, (min(sizes)[0], top)]


def asked_postings(spark: SparkSession, folder: str, words: list[str], bands: tuple[int, int],
                   buckets: int = BUCKETS) -> DataFrame:
    """Rows of some words and bands; folders and row groups of others are not read."""
    asked = spark.createDataFrame([(w,) for w in words], "word string").select(
        _bucket(F.col("word"), buckets).alias("b")).distinct().collect()
    return spark.read.schema(_POSTINGS).parquet(f"{folder}/postings-{buckets}").where(
        F.col("bucket").isin([r.b for r in asked]) & F.col("word").isin(words) & F.col("band").between(*bands))


def search_titles(works: DataFrame, work_topics: DataFrame, authorships: DataFrame, folder: str, query: str,
                  topics: list[str] | None = None, authors: list[str] | None = None,
                  years: tuple[int, int] | None = None, n: int = EVIDENCE_ROWS,
                  buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``views.evidence_works`` for a plain title text, from the index of the same works.

    Bands are read from the most cited down, until ``n`` works have passed all filters.  A query without a
    word, or with a part of too many words, is answered from ``works``.
    """
    spark = works.sparkSession
    words = matching_words(spark, folder, query, buckets)
    columns = ["work_id", "title", "publication_year", "cited_by_count"]
    if words is None:
        return evidence_works(works.select(*columns), work_topics, authorships, topics, authors, years, query, n)
    sizes = spark.read.schema(_WORDS).parquet(f"{folder}/words-{buckets}").where(F.col("word").isin(words)).groupBy("band").agg(
        F.sum("works").alias("works")).collect()  # a row per band
    found = works.select(*columns).limit(0)
    for bands in band_steps([(r.band, r.works) for r in sizes], n):
        rows = asked_postings(spark, folder, words, bands, buckets).select(*columns).dropDuplicates(["work_id"])
        passed = evidence_works(rows, work_topics, authorships, topics, authors, years, query, n)
        found = materialise(found.unionByName(passed))
        if found.count() >= n:
            break
    return found.orderBy(F.desc("cited_by_count"), "work_id").limit(n)
