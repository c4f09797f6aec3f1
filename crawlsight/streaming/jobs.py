"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.journeys import fetch_issues


def classified(log: DataFrame) -> DataFrame:
    """A stream of fetches with their issue codes; no state."""
    return fetch_issues(log)


def first_issues(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (code, url) once within the watermark, across restarts. ``log`` has ts."""
    rows = fetch_issues(log).withWatermark("ts", late).select("ts", "url", F.explode("issues").alias("code"))
    return rows.dropDuplicatesWithinWatermark(["code", "url"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) in tumbling windows of ``events`` (ts, event_type, value), batch or stream."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n): sessions that a gap ends, batch or stream."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
