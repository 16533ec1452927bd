"""Hand-computed answers on small tables."""

import pytest
from helpers import as_dict, corpus, table
from pyspark.sql import functions as F

from fieldpulse.functions.columns import extract_id, reconstruct_abstract, title_tokens
from fieldpulse.functions.stats import exact_percentiles
from fieldpulse.operators import emerging, evaluate, evolution, graph, ingest, transitions, views
from fieldpulse.schemas import RAW_WORKS, TABLES, empty
from fieldpulse.sources import sinks
from fieldpulse.sources.works import load_table

SMALL = [("W1", 2018, 5, ["T1"], ["a", "b"]), ("W2", 2018, 3, ["T2"], ["a"]),
         ("W3", 2019, 7, ["T1"], ["a", "c"]), ("W4", 2019, 1, ["T1", "T2"], ["d", ""])]


def counts(spark, rows):
    return spark.createDataFrame(
        [(t, t, y, n, 0) for t, y, n in rows],
        "topic_id string, topic_name string, year int, work_count int, citation_sum long")


@pytest.fixture(scope="module")
def gap_stats(spark):
    return evolution.stats_from_counts(counts(spark, [
        ("T1", 2018, 10), ("T1", 2019, 15), ("T1", 2021, 30),
        ("T2", 2018, 10), ("T2", 2019, 5), ("T2", 2020, 20), ("T2", 2021, 10)]))


def test_growth_share_momentum_with_a_gap(gap_stats):
    rows = {(r.topic_id, r.year): (r.relative_share, r.growth_rate, round(r.momentum, 6))
            for r in gap_stats.collect()}
    assert rows == {
        ("T1", 2018): (0.5, 0, 0), ("T1", 2019): (0.75, 0.5, 0.25), ("T1", 2021): (0.75, 0, 0.25),
        ("T2", 2018): (0.5, 0, 0), ("T2", 2019): (0.25, -0.5, -0.25),
        ("T2", 2020): (1.0, 3.0, 0.833333), ("T2", 2021): (0.25, -0.5, 0.666667)}


def test_acceleration_with_a_gap(gap_stats):
    got = as_dict(emerging.acceleration(gap_stats), ["topic_id", "year"], "acceleration")
    assert got == {("T1", 2018): 0, ("T1", 2019): 0.5, ("T1", 2021): 0, ("T2", 2018): 0,
                   ("T2", 2019): -0.5, ("T2", 2020): 3.5, ("T2", 2021): -3.5}


def test_counts_are_distinct_and_citations_are_not(spark):
    works, tags, _ = corpus(spark, [("W1", 2020, 7, ["T1", "T1"], []), ("W2", None, 9, ["T1"], [])])
    row = evolution.topic_year_counts(
        evolution.topic_works(works, tags), evolution.topic_names(tags)).collect()
    assert [(r.topic_id, r.year, r.work_count, r.citation_sum) for r in row] == [("T1", 2020, 1, 14)]


def test_merge_keeps_seed_only_rows(spark):
    seed = counts(spark, [("T1", 2018, 99), ("T9", 2018, 4)])
    got = as_dict(evolution.merge_counts(seed, counts(spark, [("T1", 2018, 2)])),
                  ["topic_id", "year"], "work_count")
    assert got == {("T1", 2018): 2, ("T9", 2018): 4}


def test_author_signals(spark):
    works, tags, people = corpus(spark, SMALL)
    tay = emerging.topic_author_year(evolution.topic_works(works, tags), people)
    rows = {(r.topic_id, r.year): (round(r.new_author_fraction, 6), round(r.cross_topic_score, 6))
            for r in emerging.author_signals(tay).collect()}
    assert rows == {("T1", 2018): (1, 0.5), ("T2", 2018): (1, 1), ("T1", 2019): (0.666667, 0.333333),
                    ("T2", 2019): (1, 1)}


def test_transitions(spark):
    works, tags, people = corpus(spark, SMALL)
    got = transitions.topic_transitions(
        evolution.topic_works(works, tags), evolution.topic_names(tags), people).collect()
    assert [(r.src_topic_id, r.tgt_topic_id, r.year, r.next_year, r.overlap_count, r.overlap_ratio,
             r.transition_type, r.structural, r.behavioral) for r in got] == [
        ("T2", "T1", 2018, 2019, 1, 1.0, "transfer", 1.0, 1.0)]


def test_transitions_build_zero_pairs_only_for_a_threshold_that_keeps_them(spark):
    works, tags, people = corpus(spark, SMALL + [("W5", 2018, 1, ["T3"], ["z"])])
    tagged = evolution.topic_works(works, tags)
    every = transitions.topic_transitions(tagged, evolution.topic_names(tags), people, threshold=0.0).collect()
    # sources T1, T2, T3 in 2018 and targets T1, T2 in 2019 give 3 * 2 - 2 pairs
    assert len(every) == 4
    assert {(r.src_topic_id, r.tgt_topic_id): r.overlap_ratio for r in every}[("T3", "T1")] == 0


@pytest.mark.parametrize("scores, expected", [
    ([1.0, 2.0, 3.0, 10.0], ["declining", "established", "established", "emerging"]),
    ([1.0, 1.0, 1.0, 1.0], ["emerging"] * 4)])
def test_quartiles(spark, scores, expected):
    df = spark.createDataFrame(list(enumerate(scores)), "i int, composite_score double")
    got = emerging.classify_quartiles(df).orderBy("i").collect()
    assert [r.classification for r in got] == expected


def test_percentiles_are_exact_beyond_the_bracket_size(spark):
    df = spark.range(25_000).select(((F.col("id") * 7919) % 25_000).cast("double").alias("x"))
    df = df.unionByName(spark.range(10_000).select(F.lit(77.0).alias("x")))
    got = exact_percentiles(df, "x", [0.25, 0.5, 0.75], accuracy=500).first()
    want = df.agg(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    assert list(got) == want


def test_abstract_and_ids(spark):
    df = spark.createDataFrame(
        [({"b": [1, 3], "a": [0, 2]}, "https://example.org/W123"), ({}, "W123"), (None, None), (None, "")],
        "idx map<string,array<int>>, url string")
    got = df.select(reconstruct_abstract("idx"), extract_id("url")).collect()
    assert [tuple(r) for r in got] == [("a b a b", "W123"), ("", "W123"), ("", ""), ("", "")]


def test_title_tokens(spark):
    text = "Graph Neural Networks (GNNs) for the Web-scale, c3po data"
    got = spark.range(1).select(title_tokens(F.lit(text)).alias("w")).first().w
    assert set(got) == {"graph", "neural", "networks", "gnns", "data"}


def raw(spark):
    topic = lambda i: {"id": f"x/T{i}", "display_name": f"t{i}", "score": 0.5, "subfield": {"id": "x/1702"}}
    person = lambda i, inst: {"author_position": "first", "author": {"id": f"x/A{i}", "display_name": f"a{i}"},
                              "institutions": [{"id": f"x/I{j}", "display_name": f"i{j}"} for j in inst]}
    one = {"id": "x/W1", "display_name": "one", "publication_year": 2020, "cited_by_count": 9, "type": "article",
           "topics": [topic(1), topic(2)], "authorships": [person(1, [1, 2]), person(2, [])],
           "abstract_inverted_index": {"hi": [0]}, "referenced_works": ["x/W7", "x/W8"]}
    rows = [one, {**one, "display_name": "zwei"}, {**one, "id": ""}, {"id": "x/W4"}]
    names = [f.strip().split(" ")[0] for f in
             ("id,display_name,publication_year,cited_by_count,type,topics,authorships,"
              "abstract_inverted_index,referenced_works").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_WORKS)


def test_ingest(spark):
    t = {k: v.collect() for k, v in ingest.flat_tables(raw(spark)).items()}
    assert sorted((r.work_id, r.title, r.cited_by_count, r.abstract_text, r.primary_topic_id)
                  for r in t["works"]) == [("W1", "one", 9, "hi", "T1"), ("W4", "", 0, "", None)]
    assert len(t["work_topics"]) == 2 and len(t["citations"]) == 2
    assert sorted((r.author_id, r.institution_id) for r in t["authorships"]) == [("A1", "I1"), ("A2", "")]
    kept = ingest.flat_tables(raw(spark), keep_duplicates=True)
    assert kept["works"].count() == 2 and kept["citations"].count() == 4


def test_seed_counts(spark):
    got = ingest.seed_topic_year_counts(raw(spark)).collect()
    assert sorted((r.topic_id, r.year, r.work_count) for r in got) == [("T1", 2020, 1), ("T2", 2020, 1)]


def triangles(spark):
    pairs = [("1", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("4", "6"), ("5", "6"), ("3", "4")]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], TABLES["community_edges"])
    nodes = spark.createDataFrame([(str(i), str(i), 3) for i in range(1, 8)],
                                  "author_id string, author_name string, paper_count int")
    return nodes, edges


def test_modularity_and_intra_share(spark):
    _, edges = triangles(spark)
    members = spark.createDataFrame([(str(i), int(i > 3)) for i in range(1, 7)],
                                    "author_id string, community_id int")
    assert round(graph.modularity(edges, members).first()[0], 6) == 0.357143
    row = graph.intra_inter_edges(edges, members).first()
    assert round(row.intra_edge_fraction, 6) == round(row.intra_weight_fraction, 6) == 0.857143


def test_correlation_of_a_constant_series_is_null(spark):
    rows = [("A", 1, 1), ("A", 2, 2), ("A", 3, 4), ("B", 1, 5), ("B", 2, 5), ("B", 3, 5), ("C", 1, 2), ("C", 3, 8)]
    got = as_dict(evaluate.trend_correlation(counts(spark, rows)), ["topic_1", "topic_2"], "correlation")
    import numpy as np
    assert got[("A", "B")] is None and got[("B", "C")] is None
    assert abs(got[("A", "C")] - np.corrcoef([1, 2, 4], [2, 0, 8])[0, 1]) < 1e-12


def test_evidence_matches_literally_unless_asked(spark):
    works, tags, people = corpus(spark, [("W1", 2020, 7, ["T1"], ["a"]), ("W2", 2021, 9, ["T2"], [])])
    found = lambda **k: sorted(r.work_id for r in views.evidence_works(works, tags, people, **k).collect())
    assert found(query="TITLE W1") == ["W1"] and found(query="title .1") == []
    assert found(query="title .1", regex=True) == ["W1"] and found(topics=["T2"]) == ["W2"]
    assert found(authors=["a"]) == ["W1"] and found(years=(2021, 2021)) == ["W2"] and found(n=1) == ["W2"]
    shown = views.evidence_table(works, tags, people).collect()
    assert [(r.work_id, r.topics, r.authors) for r in shown] == [
        ("W2", "name T2", None), ("W1", "name T1", "name a")]


def test_empty_inputs_keep_their_schema(spark):
    works, tags, people = (empty(spark, t) for t in ("works", "work_topics", "authorships"))
    tagged = evolution.topic_works(works, tags)
    stats = evolution.topic_year_stats(works, tags)
    signals = emerging.signals_from_tables(works, tags, people)
    frames = [stats, signals, emerging.representative_papers(signals, tagged, works),
              transitions.topic_transitions(tagged, evolution.topic_names(tags), people), graph.author_nodes(people),
              graph.coauthor_edges(people, graph.author_nodes(people)),
              evaluate.topic_coherence(tags, works), evaluate.trend_correlation(stats),
              evaluate.emerging_backtest(signals, stats), evaluate.signal_importance(signals, stats),
              views.flow_nodes(stats), views.emerging_heatmap(signals)]
    for df in frames:
        assert df.columns and df.count() == 0
    assert [f.split(" ")[0] for f in TABLES["topic_year_stats"].split(", ")] == stats.columns
    assert [f.split(" ")[0] for f in TABLES["emerging_topic_signals"].split(", ")] == signals.columns


def test_signals_without_authorships_are_zero(spark):
    works, tags, _ = corpus(spark, SMALL)
    rows = emerging.signals_from_tables(works, tags, empty(spark, "authorships")).collect()
    assert len(rows) == 4 and all(r.new_author_fraction == r.cross_topic_score == 0 for r in rows)


def test_loaders_and_sinks(spark, tmp_path):
    from fieldpulse.sources import sinks, works as source

    w, tags, _ = corpus(spark, SMALL)
    folder = str(tmp_path)
    sinks.overwrite_table(w, folder, "works")
    sinks.overwrite_table(w, folder, "works")
    assert source.load_table(spark, folder, "works", (2019, 2019)).count() == 2
    sinks.append_table(tags, folder, "work_topics")
    sinks.append_table(tags, folder, "work_topics")
    assert source.load_table(spark, folder, "work_topics").count() == 10
    sinks.overwrite_table(empty(spark, "works"), folder, "works")
    assert source.load_table(spark, folder, "works").count() == 0


def test_years_are_folders(spark, tmp_path):
    from fieldpulse.sources import sinks, works as source

    folder = str(tmp_path)
    rows = [dict(work_id=f"W{i}", publication_year=y) for i, y in enumerate([2018, 2019, 2019, 2020, None])]
    sinks.overwrite_table(table(spark, "works", rows), folder, "works")
    assert (tmp_path / "works" / "publication_year=2019").is_dir()
    asked = source.load_table(spark, folder, "works", (2019, 2020))
    assert asked.columns == [f.split(" ")[0] for f in TABLES["works"].split(", ")]
    assert sorted(r.work_id for r in asked.collect()) == ["W1", "W2", "W3"]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publication_year" in plan and "DataFilters: []" in plan
    every = source.load_table(spark, folder, "works").collect()
    assert sorted((r.work_id, r.publication_year) for r in every)[-1] == ("W4", None)


def _record(title, topic, **extra):
    return {"id": "https://example.org/W1", "display_name": title, "publication_year": 2019, "cited_by_count": 3,
            "topics": [{"id": f"https://example.org/{topic}", "display_name": topic, "score": 1.0}], **extra}


def test_first_delivery_wins_although_its_title_sorts_last(spark, tmp_path):
    import json
    import os

    from fieldpulse.sources.works import read_works

    for i, title in enumerate(["zwei", "one"]):
        file = tmp_path / f"{1 - i}.json"  # the later file has the smaller name
        file.write_text(json.dumps(_record(title, f"T{i}")))
        os.utime(file, (1_600_000_000 + i, 1_600_000_000 + i))
    tables = ingest.flat_tables(read_works(spark, str(tmp_path)))
    assert [r.title for r in tables["works"].collect()] == ["zwei"]
    assert [r.topic_id for r in tables["work_topics"].collect()] == ["T0"]


def test_children_come_from_the_surviving_copy(spark, tmp_path):
    import json

    from fieldpulse.sources.works import read_works

    (tmp_path / "a.json").write_text("\n".join(json.dumps(_record(
        "same", topic, referenced_works=[f"https://example.org/{topic}"])) for topic in ["T9", "T1"]))
    tables = ingest.flat_tables(read_works(spark, str(tmp_path)))
    assert [r.primary_topic_id for r in tables["works"].collect()] == ["T9"]
    assert [r.topic_id for r in tables["work_topics"].collect()] == ["T9"]
    assert [r.referenced_work_id for r in tables["citations"].collect()] == ["T9"]


def test_inverted_index_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "b a  b"), (2, ""), (3, None), (4, " \t ")], "k int, t string")
    found = {r.k: r.abstract_inverted_index for r in ingest.build_inverted_index(docs, "k", "t").collect()}
    assert found == {1: {"b": [0, 2], "a": [1]}, 2: {}, 3: {}, 4: {}}


def test_refreshed_years_equal_a_rebuild(spark, tmp_path):
    old = [("a", 2000, 1, ["x"], []), ("b", 2001, 2, ["x", "y"], []), ("c", 2003, 4, ["y"], []), ("d", 2006, 1, ["x"], [])]
    new = [("e", 2001, 5, ["x"], []), ("f", 2001, 7, ["z"], []), ("g", 2004, 3, ["y"], [])]
    stats = lambda works: evolution.topic_year_stats(*corpus(spark, works)[:2])
    sinks.overwrite_table(stats(old), str(tmp_path), "topic_year_stats")
    kept = (tmp_path / "topic_year_stats" / "year=2000").stat().st_mtime_ns
    w, t, _ = corpus(spark, new)
    t = t.withColumn("topic_name", F.when(F.col("topic_id") == "y", F.lit("renamed")).otherwise(F.col("topic_name")))
    fresh = evolution.topic_year_counts(evolution.topic_works(w, t), evolution.topic_names(t))
    stored = load_table(spark, str(tmp_path), "topic_year_stats")
    assert evolution.touched_years(stored, fresh) == [2001, 2002, 2003, 2004, 2005, 2006, 2007]
    sinks.replace_years(evolution.refreshed_years(stored, fresh), str(tmp_path), "topic_year_stats")
    works, tags, _ = corpus(spark, old + new)
    tags = tags.withColumn("topic_name", F.when(F.col("topic_id") == "y", F.lit("renamed")).otherwise(F.col("topic_name")))
    want = evolution.topic_year_stats(works, tags)
    got = load_table(spark, str(tmp_path), "topic_year_stats")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert (tmp_path / "topic_year_stats" / "year=2000").stat().st_mtime_ns == kept
    assert evolution.refreshed_years(got, fresh.limit(0)).count() == 0
