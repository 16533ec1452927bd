"""Joins by work without hot works: nothing is split, and the result is that of a plain loop."""

from helpers import corpus

from fieldpulse.functions import skew
from fieldpulse.operators import emerging, evolution, graph

WORKS = [(f"W{i}", 2000 + i % 3, i, [f"T{i % 5}", f"T{i % 7}", f"T{i % 5}"], [f"A{i % 4}", f"A{i % 6}", f"A{i % 4}"]) for i in range(60)]


def test_topic_authors_without_hot_works_are_dealt_out_by_work(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    works, tags, people = corpus(spark, WORKS + [("X", 2000, 1, ["T0"], ["", None])])
    monkeypatch.setattr(emerging, "dealt", lambda df, key, rows: skew.dealt(df, key, rows, 10))
    found = emerging.topic_author_year(evolution.topic_works(works, tags), people)
    assert sorted(map(tuple, found.collect())) == sorted({(t, a, y) for _, y, _, ts, as_ in WORKS for t in ts for a in as_})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" not in plan and "RepartitionByExpression" in plan  # one deal by work, no salt


def test_pairs_without_hot_works(spark):
    _, _, people = corpus(spark, WORKS)
    pairs = skew.distinct_pairs(emerging.work_authors(people), "work_id", "author_id")
    assert sorted(map(tuple, pairs.collect())) == sorted(
        (w, a, b) for w, _, _, _, as_ in WORKS for a in set(as_) for b in set(as_) if a < b)
    assert "blk" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    halves = skew.distinct_pairs(emerging.work_authors(people), "work_id", "author_id", rows_per_part=1)
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, pairs.collect()))


def test_author_counts_deal_the_rows_out_once(spark):
    works, tags, people = corpus(spark, WORKS)
    tay = emerging.topic_author_year(evolution.topic_works(works, tags), people)
    rows = [tuple(r) for r in tay.collect()]
    got = {(r.topic_id, r.year): (r.authors, r.fresh, r.single) for r in emerging.author_counts(tay).collect()}
    for (t, y), counts in got.items():
        mine = {a for u, a, z in rows if (u, z) == (t, y)}
        assert counts == (len(mine), sum(y == min(z for u, b, z in rows if (u, b) == (t, a)) for a in mine),
                          sum(len({u for u, b, z in rows if (b, z) == (a, y)}) == 1 for a in mine))
    assert emerging.author_counts(tay)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [author_id") == 2
    assert graph.coauthor_edges(people, graph.author_nodes(people)).count() > 0


def test_distinct_authors_and_their_counts_are_found_in_shares_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(emerging, "dealt", lambda df, key, rows: skew.dealt(df, key, rows, 10))
    works, tags, people = corpus(spark, WORKS)
    tagged = evolution.topic_works(works, tags)
    assert skew.joined_rows(people, tagged, "work_id", 180) == people.join(tagged, "work_id").count()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    tay = emerging.topic_author_year(tagged, people)
    made = people.join(tagged, "work_id").count()
    assert any("[topic_id" in line and line.endswith(f", {-(-made // 10)}")
               for line in plan(tay).splitlines() if "RepartitionByExpression" in line)
    parts = -(-tay.count() // 10)
    assert plan(emerging.author_counts(tay)).count(f", {parts}\n") >= 2  # both groupings by author
    assert skew.measured(people, "work_id") == (False, people.count())
    assert skew.measured(people, "work_id", 2) == (True, people.count())


def test_tags_are_counted_in_shares_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(evolution, "dealt", lambda df, key, rows: skew.dealt(df, key, rows, 10))
    works, tags, _ = corpus(spark, WORKS)
    tagged = evolution.topic_works(works, tags)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    parts = -(-tags.count() // 10)
    assert sum("RepartitionByExpression [work_id" in line and line.endswith(f", {parts}") for line in plan.splitlines()) == 3
    assert sorted(map(tuple, tagged.select("work_id", "topic_id", "year", "cited_by_count", "tag_rows").collect())) == sorted(
        (w, t, y, c, ts.count(t)) for w, y, c, ts, _ in WORKS for t in set(ts))
