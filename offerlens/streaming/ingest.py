"""Incremental ingest: landed files become offers, one micro-batch at a time, partition by partition.

The trigger decides the rhythm (a processing time, or all that is available and then stop). Batches don't overlap by
construction, and a batch that is run again replaces the same partitions with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources import store


def read_landed(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(landed: DataFrame, to_offers: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None):
    """Run to_offers on each micro-batch and replace the partitions of the sources that it brings."""

    def batch(df: DataFrame, _: int) -> None:
        store.replace_partitions(to_offers(df), path, "source_id")

    writer = landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by event type, with a watermark for late rows (an addition of ours)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
