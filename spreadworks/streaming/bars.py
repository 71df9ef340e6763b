"""Bars from an event stream: event-time windows with a watermark; the same plan runs over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ticker, start, n, volume, close) per event type and window; close is the value of the latest event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", length), F.col("event_type").alias("ticker")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"), F.max(F.struct("ts", "event_id", "value"))["value"].alias("close")
    )
    return out.select("ticker", F.col("window.start").alias("start"), "n", "volume", "close")
