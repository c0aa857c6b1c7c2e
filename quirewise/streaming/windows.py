"""Event-time windows; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Events with a time zone on their time, as a watermark needs it."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", lateness) if lateness and events.isStreaming else out


def tumbling_counts(events: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """``window, event_type, n, total`` in windows of a width, sliding where a slide is given."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events, lateness).groupBy(window.alias("window"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def session_counts(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """``window, user_id, n``: sessions that a pause ends."""
    return timed(events, lateness).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def attempt_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Running counts by user and outcome; ``exhausted`` is no attempt."""
    return timed(events, lateness).where("outcome <> 'exhausted'").groupBy("user_id", "outcome").agg(F.count("*").alias("n"))
