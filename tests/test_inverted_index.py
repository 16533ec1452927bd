from fieldpulse.operators import ingest


def test_only_texts_of_a_repeated_key_are_dealt_out(spark):
    rows = [(1, "a b  a c"), (2, None), (3, " "), (4, "x y"), (4, "y z y"), (None, "n"), (None, "n m"), (5, "é a é")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in ingest.build_inverted_index(texts, "doc_id", "text").collect():
        assert r.doc_id not in got
        got[r.doc_id] = r.abstract_inverted_index
    assert got == {1: {"a": [0, 2], "b": [1], "c": [3]}, 2: {}, 3: {}, 4: {"x": [0], "y": [0, 1, 2], "z": [1]},
                   None: {"n": [0, 0], "m": [1]}, 5: {"é": [0, 2], "a": [1]}}
    plan = ingest.build_inverted_index(texts, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan  # texts of a key of their own are indexed without a shuffle
