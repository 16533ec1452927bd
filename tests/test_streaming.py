"""The incremental jobs give what one batch gives."""

import json

from pyspark.sql import functions as F

from fieldpulse.operators import ingest
from fieldpulse.sources.works import read_works
from fieldpulse.streaming.ingest import ingest_incremental, read_ingested
from fieldpulse.streaming.live import live_topic_counts, run_available


def record(i, title="t"):
    return {"id": f"https://example.org/W{i}", "display_name": title, "publication_year": 2020 + i % 3,
            "cited_by_count": i, "type": "article",
            "topics": [{"id": f"x/T{i % 4}", "display_name": f"T{i % 4}", "score": 0.5, "subfield": {"id": "x/1"}}],
            "authorships": [{"author_position": "first", "author": {"id": f"x/A{i % 5}", "display_name": "a"},
                             "institutions": []}],
            "abstract_inverted_index": {"word": [0], f"n{i}": [1]}, "referenced_works": ["x/W1"]}


def write(folder, name, records):
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_incremental_ingest_equals_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(source, "a.json", [record(i) for i in range(6)] + [record(2)] + [{"id": ""}])
    run = lambda: ingest_incremental(spark, str(source), state, out, files_per_batch=1).awaitTermination()
    run()
    write(source, "b.json", [record(i) for i in range(4, 9)])
    write(source, "c.json", [record(i) for i in range(8, 12)] + ["broken"])
    run()
    run()
    batch = ingest.flat_tables(read_works(spark, str(source)))
    for name, rows in batch.items():
        stored = read_ingested(spark, out, name)
        assert sorted(map(tuple, stored.collect()), key=repr) == sorted(
            map(tuple, rows.select(*stored.columns).collect()), key=repr), name


def test_a_batch_reads_nothing_stored(spark, tmp_path):
    source, state, out = tmp_path / "in", str(tmp_path / "state"), tmp_path / "out"
    source.mkdir()
    run = lambda: ingest_incremental(spark, str(source), state, str(out), files_per_batch=1).awaitTermination()
    write(source, "a b+{1}.json", [record(i) for i in range(5)])
    write(source, "100%25 [2].json", [record(i) for i in range(3, 8)] + [{"id": None, "display_name": "no id"}])
    run()
    assert sorted(r.work_id for r in read_ingested(spark, str(out), "works").collect()) == [f"W{i}" for i in range(8)]
    stored = {p: p.read_bytes() for p in out.rglob("*.parquet")}
    for path in stored:
        path.write_bytes(b"not a table")  # a batch that read it would fail
    write(source, "c.json", [record(i, "late") for i in range(2, 10)])
    write(source, "d.json", [])
    run()
    for path, rows in stored.items():
        path.write_bytes(rows)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    rows = {r.work_id: r.title for r in read_ingested(spark, str(out), "works").collect()}
    assert rows == {f"W{i}": "late" if i > 7 else "t" for i in range(10)}
    assert read_ingested(spark, str(out), "work_topics").count() == 10


def test_a_broken_record_does_not_take_the_place_of_a_whole_one(spark, tmp_path):
    source, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    source.mkdir()
    run = lambda: ingest_incremental(spark, str(source), state, out).awaitTermination()
    (source / "a.json").write_text('{"id": "x/W1", "display_name": \n' + json.dumps(record(2)))
    run()
    write(source, "b.json", [record(1, "whole"), record(2, "late")])
    run()
    got = {r.work_id: r.title for r in read_ingested(spark, out, "works").collect()}
    assert got["W2"] == "t" and set(got) == {"W1", "W2"}


def test_live_counts_equal_the_batch_counts(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.range(200).select(
        F.concat(F.lit("W"), F.col("id")).alias("work_id"), F.concat(F.lit("T"), F.col("id") % 3).alias("topic_id"),
        F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"))
    rows.repartition(3).write.parquet(folder)
    rows.limit(50).write.mode("append").parquet(folder)  # repeated deliveries
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    got = run_available(live_topic_counts(stream, delay="30 days"), spark)
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "topic_id").agg(F.count("*").alias("work_count")).select(
        F.col("w.start").alias("period_start"), "topic_id", "work_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_topic_of_a_work_is_counted_over_batches(spark, tmp_path):
    folder = str(tmp_path / "tags")
    for rows in ([("W1", "T1"), ("W1", "T2")], [("W2", "T1"), ("W1", "T1")], [("W3", "T2")]):
        spark.createDataFrame(rows, "work_id string, topic_id string").withColumn(
            "ts", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("work_id string, topic_id string, ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(folder)
    got = run_available(live_topic_counts(stream, delay="30 days"), spark)
    assert {r.topic_id: r.work_count for r in got.collect()} == {"T1": 2, "T2": 2}


def test_a_stream_without_input_has_no_counts(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    stream = spark.readStream.schema("work_id string, topic_id string, ts timestamp").parquet(str(folder))
    assert run_available(live_topic_counts(stream), spark).count() == 0


def test_the_first_delivery_wins(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    topics = lambda t: [{"id": t, "display_name": t, "score": 1.0, "subfield": {"id": "1"}}]
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in [
        {"id": "W1", "display_name": "zwei", "topics": topics("T1")}, {"id": "W1", "display_name": "one", "topics": topics("T2")},
        {"id": "W2", "display_name": "same", "topics": topics("T9")}, {"id": "W2", "display_name": "same", "topics": topics("T8")}]))
    tables = ingest.flat_tables(read_works(spark, str(source)))
    assert {r.work_id: r.title for r in tables["works"].collect()} == {"W1": "zwei", "W2": "same"}
    assert {(r.work_id, r.topic_id) for r in tables["work_topics"].collect()} == {("W1", "T1"), ("W2", "T9")}
    ingest_incremental(spark, str(source), str(tmp_path / "state"), out).awaitTermination()
    assert {r.work_id: r.title for r in read_ingested(spark, out, "works").collect()} == {"W1": "zwei", "W2": "same"}


def test_deliveries_are_compressed_files_of_few_records(spark, tmp_path, monkeypatch):
    from fieldpulse.plans import queries

    monkeypatch.setattr(queries, "FILE_RECORDS", 2)
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path / "out"))
    for name, rows, schema in (
            ("orders", [(i, 1, "O" if i % 2 else "F", "1-URGENT", "2020-01-01", 5000.0) for i in range(1, 8)],
             "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string, o_totalprice double"),
            ("customer", [(1, "C", 1, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
            ("nation", [(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"),
            ("region", [(1, "R")], "r_regionkey int, r_name string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = queries.incremental_ingest(spark, str(tmp_path)).collect()
    assert sorted(r.work_id for r in rows) == [f"W{i}" for i in range(1, 8)] and {r.title for r in rows} == {"1-URGENT"}
    files = [f.name for f in (tmp_path / "out").glob("ingest-*/in/part-*")]
    assert len(files) >= 6 and all(f.endswith(".json.gz") for f in files)
