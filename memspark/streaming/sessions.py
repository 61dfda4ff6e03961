"""Session life cycle on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def session_spans(events: DataFrame, gap: str = "48 hours", late: str = "5 minutes") -> DataFrame:
    """One row per session and active span; a span without an end event that stays silent for ``gap`` is stuck."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    ended = F.max(F.when(F.col("hook_type") == "session_end", 1).otherwise(0)) == 1
    spans = events.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.count(F.lit(1)).alias("events"), ended.alias("ended")
    )
    return spans.select(
        "session_id", "started_at", "last_event_at", "events", F.when(F.col("ended"), "completed").otherwise("stuck").alias("status")
    )
