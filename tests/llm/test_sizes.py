"""Tables that Spark sizes like the smaller ones they come from are not sent to the driver."""

from fieldpulse.llm import near, simhash


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_copies_of_fingerprints_are_not_broadcast(spark):
    links = simhash.near_links(spark.range(1000).selectExpr("xxhash64(id) as fp"))
    assert "Broadcast" not in plan(links) and "SortMergeJoin" in plan(links)


def test_shingles_bands_and_classes_are_not_broadcast(spark):
    nodes = spark.range(100).selectExpr(
        "1L as family", "id as node", "9 as core", "12 as size", "7 as q", "array(id, id + 1, id + 2, id + 3) as own")
    own = nodes.selectExpr("node", "own as bands")
    for found in near._shared_shingles(nodes), near._band_stars(own):
        assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
        assert not found.isEmpty()
    seen = []
    near_written, near.materialise = near.materialise, lambda df: seen.append(plan(df)) or near_written(df)
    try:
        near._core_pairs(nodes, nodes.selectExpr("node", "node as root"))
    finally:
        near.materialise = near_written
    assert "Generate explode" in seen[-1] and "Broadcast" not in seen[-1]
