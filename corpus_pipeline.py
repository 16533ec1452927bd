"""A training corpus from ``documents`` in five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, folder)``; its result is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm import decontaminate, hilbert, near, raking, simhash, toxicity
from fieldpulse.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.clean_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of texts with 0.8 or more of their five-word shingles in common.

    Texts meet by SimHash fingerprints through anchors, as in ``op4``, and by MinHash bands for edits beyond two bits; an exact
    check of all that met follows.
    """
    return near.keep_first(docs, candidates=simhash.groups(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def sample_mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents drawn by probabilities that are raked to source, language and topic targets."""
    return raking.drawn_rows(docs, keep=raking.KEEP)


def cut_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Shard and slot of every remaining document along the Hilbert curve."""
    return hilbert.assign_shards(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", sample_mixture),
    ("sharding", cut_shards),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; the results of the stages stay in the shared folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{base}/{place}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{place}-{name}")
    return docs
