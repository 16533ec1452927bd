"""Text preparation: papers with abstracts, terms, vocabulary, TF-IDF and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unit, word_tokens
from ..functions.ranking import top_rows
from ..functions.stats import with_scalar

# Vocabulary limits and embedding batch.
MAX_DF, MIN_DF = 0.85, 3
BATCH = 64


def papers_with_abstract(works: DataFrame, top: int | None = None) -> DataFrame:
    """``(work_id, abstract_text)`` of works with text; ``top`` keeps the most cited ones.

    The ranking moves ids and citations only; texts are looked up for the chosen.
    """
    papers = works.where(F.length(F.trim("abstract_text")) > 0)
    if top is not None:
        best = top_rows(papers.select("work_id", "cited_by_count"),
                        [F.desc("cited_by_count"), F.asc("work_id")], top)
        papers = papers.join(best.select("work_id"), "work_id", "left_semi")
    return papers.select("work_id", "abstract_text")


def document_terms(papers: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``(work_id, term, tf)``: words of two or more characters, English stop words removed.

    The default stop list is the one that comes with Spark ML.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    terms = papers.select("work_id", F.explode(word_tokens("abstract_text")).alias("term"))
    return terms.where(~F.col("term").isin(list(stop_words))).groupBy("work_id", "term").agg(
        F.count("*").alias("tf"))


def vocabulary(papers: DataFrame, terms: DataFrame, max_df: float = MAX_DF, min_df: int = MIN_DF,
               max_features: int | None = None) -> DataFrame:
    """``(term, df, total)`` within the document-frequency limits; ``max_features`` keeps the most used.

    On a small corpus the lower limit shrinks to a third of the documents.
    """
    n = F.col("_n")
    least = F.least(F.lit(min_df), F.greatest(F.lit(1), F.floor(n / 3)))
    words = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    words = with_scalar(words, "_n", papers.agg(F.count("*").alias("n"))).where(
        (F.col("df") >= least) & (F.col("df") <= F.lit(max_df) * n)).drop("_n")
    return words if max_features is None else top_rows(
        words, [F.desc("total"), F.asc("term")], max_features)


def tfidf(papers: DataFrame, terms: DataFrame, vocab: DataFrame, n_docs: int | None = None) -> DataFrame:
    """``(work_id, term, weight)``: (1 + ln tf) * (ln((1+n)/(1+df)) + 1), unit length per document.

    n is the number of papers, or ``n_docs`` where the vocabulary comes from another corpus.
    """
    known = vocab.withColumn("_n", F.lit(n_docs)) if n_docs is not None else with_scalar(
        vocab, "_n", papers.agg(F.count("*").alias("n")))
    known = known.select(
        "term", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = terms.join(known, "term").select(
        "work_id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("work_id")))
    return rows.select("work_id", "term", (F.col("w") / norm).alias("weight"))


def embed_documents(papers: DataFrame, encoder: Callable[[], Callable[[list[str]], object]] | None = None,
                    dims: int = 256, batch: int = BATCH) -> DataFrame:
    """``(work_id, embedding)`` of unit length.

    ``encoder`` is called once per task and returns a function from a list of
    texts to a matrix; it sees batches of ``batch`` whole texts.  Without an
    encoder the embedding is hashed TF-IDF, computed by Spark ML.
    """
    if encoder is None:
        words = papers.select("work_id", word_tokens("abstract_text").alias("words"))
        stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=dims),
                  IDF(inputCol="tf", outputCol="weighted"),
                  Normalizer(inputCol="weighted", outputCol="vector")]
        return Pipeline(stages=stages).fit(words).transform(words).select(
            "work_id", vector_to_array("vector", "float32").alias("embedding"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                rows = model(part["abstract_text"].tolist())
                yield pd.DataFrame({"work_id": part["work_id"].tolist(),
                                    "embedding": np.asarray(rows, dtype="float64").tolist()})

    coded = papers.select("work_id", "abstract_text").mapInPandas(
        encode, "work_id string, embedding array<double>")
    return coded.select("work_id", F.transform(
        unit("embedding"), lambda x: x.cast("float")).alias("embedding"))
