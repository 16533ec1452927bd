"""Incremental ingest: new files of work records become new rows of the flat tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import extract_id
from ..operators.ingest import flat_tables
from ..schemas import RAW_WORKS, TABLES
from ..session import materialise
from ..sources.works import read_works

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A file name is sent to this many keys at most, so that no key holds all records of a large file.
FILE_KEYS = 64


def read_ingested(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All rows of an ingested table."""
    columns = [f.split(" ")[0] for f in TABLES[table].split(", ")]
    return spark.read.parquet(f"{folder}/{table}").select(*columns)


def _readable(path: str) -> str:
    """A path as the metadata column gives it, as a reader takes it: decoded, pattern characters escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(path))


def first_seen(records: DataFrame) -> DataFrame:
    """``(work_id, file)`` of a stream: the ids no earlier batch held, and rows without an id that name the batch's files.

    Both are kept in the keyed state of the stream, which looks up the keys of a batch and no others.
    """
    work, part = extract_id("id"), F.pmod(F.xxhash64("id"), F.lit(FILE_KEYS)).cast("string")
    marks = F.array(
        F.struct(F.concat(F.lit("work "), work).alias("key"), work.alias("work_id"), F.lit("").alias("file")),
        F.struct(F.concat(F.lit("file "), part, F.lit(" "), F.col("_metadata.file_path")).alias("key"),
                 F.lit("").alias("work_id"), F.col("_metadata.file_path").alias("file")))
    return (
        records.select(F.explode(marks).alias("mark")).select("mark.*")
        .where((F.col("work_id") != "") | (F.col("file") != "")).dropDuplicates(["key"]).drop("key"))


def ingest_incremental(spark: SparkSession, source: str, checkpoint: str, folder: str,
                       files_per_batch: int = 100) -> StreamingQuery:
    """Process the files not seen before and stop; works already stored are skipped.

    The ids seen so far are the state of the stream, in an embedded store on the executors' disks with its
    changes saved under ``checkpoint``.  A batch reads its files twice, for the ids and for the records, and
    nothing of the stored tables, however large they are.  The number of state partitions is
    ``spark.sql.shuffle.partitions`` at the first run.

    Every batch owns one folder per table and replaces it when it is repeated
    after a failure, so a half-written batch leaves neither gaps nor copies.  Files must not change
    or go before their batch is done.
    """
    stream = (
        spark.readStream.schema(RAW_WORKS).option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "PERMISSIVE").json(source))

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        marks = materialise(batch)
        # as many as a batch has files
        files = [r.file for r in marks.where("file <> ''").select("file").distinct().collect()]
        records = read_works(session, [_readable(f) for f in files]) if files else session.createDataFrame([], RAW_WORKS)
        fresh = marks.where("work_id <> ''").select(F.col("work_id").alias("_fresh"))
        chosen = records.join(fresh, extract_id("id") == F.col("_fresh"), "left_semi")
        for table, rows in flat_tables(chosen).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch_id}")

    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)  # the stream takes its settings at the start
    try:
        return (
            first_seen(stream).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE_SETTING, before)
