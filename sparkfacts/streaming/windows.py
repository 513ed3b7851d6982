"""Windows over event streams: an extension, nothing like it is asked for elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their value by hour and type; on a stream, late rows count up to ``late``."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events no further apart than the gap."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
