"""The moment and event logic over streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_moments(events: DataFrame, late: str = "1 day", gap: str = "6 hours") -> DataFrame:
    """Sessions by user: count, best value, first and last time. events: user_id, ts (timestamp), value."""
    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("assets"), F.max("value").alias("best"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.drop("session_window")


def tumbling_levels(events: DataFrame, late: str = "1 day", width: str = "1 day", step: str | None = None) -> DataFrame:
    """Counts and peaks by user and window; with a step, sliding windows."""
    window = F.window("ts", width, step) if step else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
