"""The mixture with a stated share of the tokens."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldpulse.llm import raking

SCHEMA = "doc_id bigint, text string, lang string, source string"


def corpus(n=3000):
    rng = random.Random(12)
    return [(i, "w " * rng.randint(20, 40), rng.choice("xxxyz"), rng.choice("aaaaaabbcd")) for i in range(n)]


def share_of(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    drawn = corpus_pipeline.sample_mixture(spark, docs, "")
    assert drawn.columns == docs.columns
    tokens = lambda df: df.agg(F.sum(raking.tokens_of(F.col("text")))).first()[0]
    return tokens(drawn) / tokens(docs), {r.doc_id for r in drawn.collect()}


def test_one_odd_row_costs_no_others(spark):
    rows = corpus()
    plain, _ = share_of(spark, rows)
    for odd in ("w", "w " * 20):
        share, ids = share_of(spark, rows + [(9999, odd, "x", "rare")])
        assert abs(share - plain) < 0.02 and abs(share - raking.KEEP) < 0.04
        assert 9999 in ids  # the only row of its source has fewer tokens than the target


def test_bounded_meets_targets(spark):
    cells = raking.cells_of(spark.createDataFrame(corpus() + [(9999, "w", "x", "rare")], SCHEMA)).cache()
    targets = {d: raking.tempered(cells, d, raking.TEMPER[d]) for d in raking.DIMENSIONS}
    found, goals, gap = raking.bounded(cells, targets)
    assert gap <= raking.TOLERANCE and found.where("probability < 0 or probability > 1").count() == 0
    total = cells.agg(F.sum("tokens")).first()[0]
    for r in raking.margins(found, goals).collect():
        assert abs(r.reached / r.goal - 1) <= raking.TOLERANCE
    assert abs(found.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] / total - raking.KEEP) < 0.01
    assert raking.mix(spark.createDataFrame([], SCHEMA), keep=0.5).count() == 0


def test_targets_that_cannot_be_met_are_told(spark):
    # every source holds one language
    rows = [(i, "w " * 10, "x" if i % 10 else "y", "a" if i % 10 > 4 else "b" if i % 10 else "c") for i in range(400)]
    cells = raking.cells_of(spark.createDataFrame(rows, SCHEMA)).cache()
    targets = {d: raking.tempered(cells, d, p) for d, p in {"source": 0.3, "lang": 1.0, "topic": 1.0}.items()}
    with pytest.warns(UserWarning, match="misses a target"):
        _, _, gap = raking.bounded(cells, targets, rounds=4)
    assert gap > raking.TOLERANCE
    with pytest.warns(UserWarning, match="weights miss a target"):
        raked = raking.rake(cells, targets)
    assert raked.first()["gap"] > raking.TOLERANCE
