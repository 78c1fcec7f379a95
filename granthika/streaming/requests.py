"""Structured Streaming: request metrics in windows, incremental ingest of changed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and their mean value by window and type; rows later than the watermark are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def ingest_changes(changes: DataFrame, target: str, checkpoint: str, key: str = "doc_id"):
    """Appends each micro-batch as a version of its documents; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
