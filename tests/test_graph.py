"""Communities on graphs with a known answer, and joins with one very large key."""

from collections import Counter
from itertools import combinations

import pytest
from helpers import table
from pyspark.sql import functions as F

from fieldpulse.functions.ranking import numbered, top_rows
from fieldpulse.functions.skew import distinct_pairs, hot_keys, split_join
from fieldpulse.operators import communities, emerging, evolution, graph
from fieldpulse.schemas import TABLES


def build(spark, pairs, n):
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], TABLES["community_edges"])
    nodes = spark.createDataFrame([(f"{i:03d}", f"n{i}", 3 + i % 4) for i in range(n)],
                                  "author_id string, author_name string, paper_count int")
    return nodes, edges


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.community_id, set()).add(r.author_id)
    return out


def test_two_triangles_and_an_isolated_author(spark):
    pairs = [("000", "001"), ("000", "002"), ("001", "002"), ("003", "004"), ("003", "005"),
             ("004", "005"), ("002", "003")]
    nodes, edges = build(spark, pairs, 7)
    found = groups(communities.detect_communities(nodes, edges))
    assert found == {0: {"000", "001", "002"}, 1: {"003", "004", "005"}, 2: {"006"}}


@pytest.fixture(scope="module")
def planted(spark):
    """Ten dense groups of eight with a few links between them."""
    name = lambda i: f"{i:03d}"
    pairs = [(name(a), name(b)) for g in range(10) for a, b in combinations(range(g * 8, g * 8 + 8), 2)
             if (a * 7 + b) % 5]
    pairs += [(name(i), name(i + 11)) for i in range(0, 66, 6)]
    return build(spark, sorted(set(pairs)), 80)


def test_planted_groups_are_found(spark, planted):
    nodes, edges = planted
    found = communities.detect_communities(nodes, edges)
    truth = nodes.select("author_id", (F.col("author_id").cast("int") / 8).cast("int").alias("community_id"))
    q = graph.modularity(edges, found).first()[0]
    assert q >= graph.modularity(edges, truth).first()[0] - 0.02
    alone = nodes.select("author_id", F.col("author_id").cast("int").alias("community_id"))
    spread = graph.label_propagation(nodes, edges, 3).select("author_id", F.col("label").alias("community_id"))
    assert q > graph.modularity(edges, alone).first()[0]
    assert q >= graph.modularity(edges, spread).first()[0]


def test_communities_are_connected(spark, planted):
    nodes, edges = planted
    links = {}
    for r in edges.collect():
        links.setdefault(r.source_author_id, set()).add(r.target_author_id)
        links.setdefault(r.target_author_id, set()).add(r.source_author_id)
    for members in groups(communities.detect_communities(nodes, edges)).values():
        todo, seen = [min(members)], set()
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [b for b in links.get(a, ()) if b in members and b not in seen]
        assert seen == members


def test_long_chain_connects(spark):
    from fieldpulse.operators.communities import G, connected_parts

    n = 120
    members = spark.range(n).select(F.lit(0).alias(G), "id", F.lit(5).cast("long").alias("comm"))
    steps = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    arcs = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts = connected_parts(members, arcs.withColumn("weight", F.lit(1.0)))
    assert [r.comm for r in parts.select("comm").distinct().collect()] == [0]


def test_robustness_covers_every_threshold(spark, planted):
    nodes, edges = planted
    rows = {r.min_papers: r for r in communities.graph_robustness(nodes, edges, (1, 5, 50)).collect()}
    assert rows[1].n_authors == 80 and rows[1].n_edges == edges.count() and rows[1].modularity > 0.5
    assert rows[5].n_authors == 40 and rows[5].n_edges < rows[1].n_edges
    assert (rows[50].n_authors, rows[50].n_edges, rows[50].modularity) == (0, 0, None)


def test_thresholds_that_keep_the_same_authors_are_partitioned_once(spark, monkeypatch):
    seen = []

    def alone(copies, arcs, least_gain):
        seen.extend(sorted(r.graph for r in copies.select("graph").distinct().collect()))
        number = lambda name: F.xxhash64("graph", name)
        return copies.select("graph", "node", number("node").alias("id"), number("node").alias("comm")), arcs.select(
            number("src").alias("src"), number("dst").alias("dst"), "weight")

    monkeypatch.setattr(communities, "partition_graphs", alone)
    nodes = spark.createDataFrame([("a", "A", 9), ("b", "B", 9), ("c", "C", 3)], "author_id string, author_name string, paper_count int")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "source_author_id string, target_author_id string, weight int")
    rows = {r.min_papers: tuple(r)[1:4] for r in communities.graph_robustness(nodes, edges, (1, 2, 5, 8, 50)).collect()}
    assert seen == [1, 5]
    assert rows == {1: (3, 2, 3), 2: (3, 2, 3), 5: (2, 1, 2), 8: (2, 1, 2), 50: (0, 0, 0)}


def test_pairs_of_a_large_work_equal_the_plain_self_join(spark):
    rows = [("hot", f"a{i:03d}") for i in range(90)] + [(f"w{i}", f"a{j:03d}") for i in range(9) for j in range(i)]
    df = spark.createDataFrame(rows, "work string, author string")
    got = [tuple(r) for r in distinct_pairs(df, "work", "author", rows_per_part=16).collect()]
    by_work = {}
    for w, a in rows:
        by_work.setdefault(w, []).append(a)
    want = [(w, a, b) for w, members in by_work.items() for a, b in combinations(sorted(members), 2)]
    assert Counter(got) == Counter(want)


def test_split_join_equals_the_plain_join(spark):
    left = spark.range(400).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(50).select((F.col("id") % 20).alias("k"), F.col("id").alias("r"))
    assert hot_keys(left, "k", 40).collect() == [(0, 4)]
    got = split_join(left, right, "k", "id", rows_per_part=40).select("k", "id", "r").collect()
    want = left.join(right, "k").select("k", "id", "r").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_numbered_equals_row_number_for_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"),
                                  "id", (F.col("id") * 37 % 11).alias("v"))
    rows = numbered(df, ["k"], [F.desc("v"), F.asc("id")]).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append(r)
    for members in by_key.values():
        ordered = sorted(members, key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in ordered] == list(range(1, len(members) + 1))


def test_long_top_list_equals_a_plain_limit(spark):
    df = spark.range(6000).select("id", (F.col("id") % 3).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    got = sorted(r.id for r in top_rows(df, order, 2500).collect())
    assert got == sorted(r.id for r in df.orderBy(*order).limit(2500).collect())


def test_a_third_of_the_rows_on_one_work_author_and_topic(spark):
    """Every operator result equals plain sets when single keys hold a large share."""
    tags = [("hot", f"t{i % 40}") for i in range(300)] + [(f"w{i}", "t0") for i in range(300)] + [
        (f"w{i}", f"t{i % 13}") for i in range(300)]
    people = [("hot", f"a{i}") for i in range(2500)] + [(f"w{i}", "a0") for i in range(300)] + [
        (f"w{i}", f"a{i % 50}") for i in range(300)]
    years = {"hot": 2000, **{f"w{i}": 2000 + i % 3 for i in range(300)}}
    works = table(spark, "works", [dict(work_id=w, publication_year=y, cited_by_count=1) for w, y in years.items()])
    wt = table(spark, "work_topics", [dict(work_id=w, topic_id=t, topic_name=t) for w, t in tags])
    au = table(spark, "authorships", [dict(work_id=w, author_id=a, author_name=a) for w, a in people])
    tagged = evolution.topic_works(works, wt)
    counts = {(r.topic_id, r.year): (r.work_count, r.citation_sum)
              for r in evolution.topic_year_counts(tagged, evolution.topic_names(wt)).collect()}
    for key in counts:
        hits = [w for w, t in tags if (t, years[w]) == key]
        assert counts[key] == (len(set(hits)), len(hits))
    topics_of, want = {}, set()
    for w, t in tags:
        topics_of.setdefault(w, set()).add(t)
    for w, a in people:
        want |= {(t, a, years[w]) for t in topics_of[w]}
    got = {(r.topic_id, r.author_id, r.year) for r in emerging.topic_author_year(tagged, au).collect()}
    assert got == want


def test_kept_weights_equal_recounted_ones(spark, planted):
    nodes, edges = planted
    ids, arcs = communities._indexed(
        nodes.select(F.lit(0).alias("graph"), F.col("author_id").alias("node")),
        graph.both_directions(edges).select(F.lit(0).alias("graph"), "src", "dst", "weight"))
    state = communities._start(ids.select("id", "graph", F.lit(0.0).alias("own")), arcs)
    mass = state.groupBy("graph").agg(F.sum("degree").alias("mass"))
    weights = communities.around(arcs, state)
    for turn in range(3):
        state = communities._moved(state, weights, mass, [0], turn)[0]
        weights = communities._reweighed(weights, arcs, state)
        assert Counter(map(tuple, weights.collect())) == Counter(map(tuple, communities.around(arcs, state).collect()))


def test_communities_come_to_rest(spark, planted):
    nodes, edges = planted
    found = communities.detect_communities(nodes, edges)
    members = found.select(F.lit(0).alias("graph"), F.col("author_id").cast("long").alias("id"),
                           F.col("community_id").cast("long").alias("comm"))
    arcs = graph.both_directions(edges).select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    for turn in range(2):
        assert communities.further_gain(members, arcs, turn).first()["gain"] < communities.LEAST_GAIN
