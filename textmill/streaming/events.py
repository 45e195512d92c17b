"""Event-time operators on streams of (event_id, ts, user_id, event_type, value); each also runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.streaming.threads import thread_log


def with_event_time(events: DataFrame, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """ts as a timestamp with a watermark; zoneless times are taken as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def idempotent(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key inside the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def usage(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, value) in tumbling, or with slide sliding, windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer gap."""
    sums = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return sums.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest(events: DataFrame) -> DataFrame:
    """(user_id, event_id, value) of the latest event of each user, ties to the larger id; for update mode."""
    best = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


def retry_budget(events: DataFrame, budget: int, idle: str = "30 days") -> DataFrame:
    """(user_id, errors, exhausted) after each event, from a count of errors kept per user until they were idle for longer; for
    append mode. events: (user_id, event_id, event_type, ts) with a watermark on ts."""
    return thread_log(events, idle, budget).filter("not closed").select("user_id", "errors", "exhausted")
