"""A published history as a stream: posts are measured once, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import style_profile
from textloom.sources.readers import parse_history


def posts(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Streaming posts of JSON-lines files that are added to a folder, with the time at which each was seen."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder)
    return parse_history(lines.withColumn("seen_at", F.current_timestamp()))


def unique(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each id once; the state of an id is dropped after the delay."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["id"])


def measured(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Style profiles of each micro-batch, by the same plan as a batch, handed to `write` (which must be idempotent by batch id)."""
    return stream.writeStream.foreachBatch(lambda batch, i: write(style_profile(batch), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shares(stream: DataFrame, window: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Posts of each pillar by tumbling window; a window is final once the watermark has passed it."""
    return stream.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window), "pillar").agg(F.count(F.lit(1)).alias("n"))
