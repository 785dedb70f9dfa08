"""The event-loss aggregate over a stream: late rows within a watermark, one result for each window and territory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Rows and largest value by window of ``ts`` and ``event_type``; works on batch and streaming frames alike."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "event_type", "n", "top")
