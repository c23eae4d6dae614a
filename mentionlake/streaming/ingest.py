"""Streaming ingestion (an extension): documents that arrive as JSON lines, linked by stateless plans per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGE = "document_id string, passage_id int, passage_offset int, text string"


def passages(spark: SparkSession, folder: str, schema: str = PASSAGE, files_per_batch: int = 1000) -> DataFrame:
    """A stream of passage rows from a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def mentions_by_window(stream: DataFrame, time: str, label: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mentions of each label in tumbling windows; rows later than the watermark are dropped by it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), label, "n")


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, available_now: bool = True):
    """Applies a batch plan to each micro-batch and appends to a folder of its own, so a repeated batch replaces itself.

    Linking depends on a mention and its document alone, so batches need no shared state."""

    def one(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
