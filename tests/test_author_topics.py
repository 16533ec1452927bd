from helpers import corpus
from pyspark.sql import functions as F

from fieldpulse.operators import evolution, transitions


def test_author_topics_travel_as_bits(spark):
    rows = [(f"W{i}", 2000 + i % 2, i, [f"T{(i * k) % 150:03d}" for k in range(1, 6)], [f"A{i % 9}", f"A{i % 9}", ""]) for i in range(200)]
    works, tags, people = corpus(spark, rows)
    sets = transitions.work_topic_sets(evolution.topic_works(works, tags))
    found = transitions.author_topic_sets(sets, people)
    expected = {}
    for _, y, _, ts, as_ in rows:
        for a in as_:
            if a:
                expected.setdefault((a, y), set()).update(ts)
    assert {(r.author_id, r.year): list(r.topics) for r in found.collect()} == {k: sorted(v) for k, v in expected.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "collect_list" not in plan
    assert transitions.author_topic_sets(sets.where(F.lit(False)), people).count() == 0
