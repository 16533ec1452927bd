import corpus_pipeline
from fieldpulse.llm import near, simhash


def test_texts_meet_by_fingerprints_before_the_exact_check(spark, monkeypatch):
    base = [f"w{i}" for i in range(800)]
    near_copy = " ".join(base[:-1] + ["a"])
    rows = [(1, " ".join(base)), (2, near_copy), (3, "other words " * 9), (None, near_copy), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(near_copy)).bit_count() <= simhash.MAX_BITS
    # every text gets bands of its own, so only fingerprints let texts meet
    monkeypatch.setattr(near, "_signed", lambda docs, key, text, run=near._signed: run(docs, key, text).selectExpr(
        "key", "copy", "node", "transform(bands, (b, i) -> xxhash64(node, i)) as bands"))
    kept = sorted((r.doc_id or 0) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [0, 1, 3, 4]
