"""Capture of a hook stream: kept observations, quarantine and live feed as three sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.operators.capture import prepare, validate_hooks, with_event_id
from memspark.streaming.dedup import dedup_stream

OBSERVATION_COLUMNS = (
    "id", "session_id", "project", "hook_type", "tool_name", "tool_input", "tool_output", "user_prompt", "raw", "modality", "has_secrets", "ts",
)


def checked(hooks: DataFrame) -> DataFrame:
    """Reject reason from parsing or validation."""
    if "parse_error" in hooks.columns:
        return validate_hooks(hooks).withColumn("reject_reason", F.coalesce("parse_error", "reject_reason")).drop("parse_error")
    return validate_hooks(hooks)


def capture_stream(hooks: DataFrame, seconds: float = 300, strict: bool = False, late: str = "5 minutes") -> DataFrame:
    good = checked(hooks).filter("reject_reason IS NULL").drop("reject_reason").filter(F.col("hook_type") != "session_end")
    ready = prepare(with_event_id(good), strict).select(*OBSERVATION_COLUMNS, "dedup_key")
    kept = dedup_stream(ready, ["session_id", "dedup_key"], "ts", "id", seconds, late)
    return kept.select(*OBSERVATION_COLUMNS)


def quarantine_stream(hooks: DataFrame) -> DataFrame:
    """Rejected rows with their reason: the dead-letter side of the capture."""
    return checked(hooks).filter("reject_reason IS NOT NULL")


def live_feed(observations: DataFrame) -> DataFrame:
    """What a viewer needs to know about a new observation."""
    return observations.select(F.lit("raw_observation").alias("type"), "session_id", F.col("id").alias("observation_id"), "ts")


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, fmt: str = "parquet") -> StreamingQuery:
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
