"""Counts per topic and period that are kept up to date while works arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def live_topic_counts(stream: DataFrame, period: str = "1 day", delay: str = "7 days", ts: str = "ts",
                      topic: str = "topic_id", key: str = "work_id") -> DataFrame:
    """Works per topic and window.

    A repeated (work, topic) row is dropped when it arrives within the delay, which also bounds that
    state; the counts of a window are given up when the watermark has passed it.
    """
    dated = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    return (
        dated.dropDuplicatesWithinWatermark([key, topic])
        .groupBy(F.window("_at", period).alias("w"), F.col(topic).alias("topic_id"))
        .agg(F.count("*").alias("work_count"))
        .select(F.col("w.start").alias("period_start"), "topic_id", "work_count"))


def run_available(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a counting stream over the available input and read back its table.

    Each batch stores only the counts that it changed; the latest count of a window and topic is valid.
    """
    base = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    keys = [c for c in counts.columns if c != "work_count"]
    spark.createDataFrame([], counts.schema).write.parquet(f"{base}/batch=-1")  # for a stream without input

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(upsert)
        .option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(counts.schema.add("batch", "long")).parquet(base)
    return rows.groupBy(*keys).agg(F.max_by("work_count", "batch").alias("work_count"))
