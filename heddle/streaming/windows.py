"""Event-time windows, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame) -> DataFrame:
    """events with ``ts`` as a timestamp: a watermark can't be put on one without a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """hour, event_type, events, total (hundredths of the values' sum) by hour. A stream drops what is later than ``lateness``."""
    rows = event_time(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    cents = F.round(F.col("value") * 100).cast("long")
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(cents).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "total")
