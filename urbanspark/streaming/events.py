"""Time series as streams: an extension, with the batch operators' meaning per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; streams need an instant for it, so a time without zone is taken in the session's."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events).withWatermark("ts", late)


def windowed_means(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and count of ``value`` per event type and window; rows later than ``late`` are dropped by the watermark."""
    by = timed(events, late).groupBy(F.window("ts", window), "event_type")
    return by.agg(F.avg("value").alias("mean_value"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "mean_value", "n")


def live_wind(events: DataFrame, directions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream-static join: each reading with its wind raster's direction (dir_key)."""
    key = F.floor(F.pmod(F.col("value"), F.lit(360.0)) / 36.0).cast("int")
    return timed(events, late).withColumn("dir_key", key).join(directions, "dir_key")
