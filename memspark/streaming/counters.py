"""Windowed counters; one function for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Events per window, project and hook type. On a stream, rows later than ``late`` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.groupBy(span.alias("w"), "project", "hook_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "project", "hook_type", "n")
