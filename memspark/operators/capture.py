"""Batch capture: hook events in, raw observations and a quarantine out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.events import dedup_key, hook_reject_reason, modality, tool_fields
from memspark.functions.privacy import redact
from memspark.functions.text import stable_id
from memspark.operators.holds import dedup_window


@dataclass(frozen=True)
class Captured:
    observations: DataFrame
    rejected: DataFrame
    sessions: DataFrame
    ended: DataFrame


def validate_hooks(events: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first failed rule, then data that is not JSON."""
    rule = hook_reject_reason(F.col("hook_type"), F.col("session_id"), F.col("ts"))
    broken = F.when(F.col("data").isNotNull() & (F.col("data") != "") & F.try_parse_json("data").isNull(), "data must be valid JSON")
    return events.withColumn("reject_reason", F.coalesce(rule, broken))


def _key(strict: bool) -> Column:
    extra = [F.col("hook_type"), F.col("user_prompt")] if strict else []
    return dedup_key(F.col("session_id"), F.col("tool_name"), F.col("tool_input"), *extra)


def with_event_id(events: DataFrame) -> DataFrame:
    """A deterministic id over the whole event; never null, so joins on it add no null test that repeats the hash."""
    made = stable_id("obs", F.col("session_id"), F.col("hook_type"), F.col("ts"), F.col("data"))
    return events.withColumn("id", F.coalesce(made, F.lit("")))


TEXT_FIELDS = ("tool_input", "tool_output", "user_prompt", "raw")


def prepare(events: DataFrame, strict: bool = False) -> DataFrame:
    """Row-wise part of the capture, the same for tables and streams: fields, redaction, modality and dedup key.

    Secrets are redacted in the decoded field values.
    """
    df = tool_fields(events).withColumn("raw", F.coalesce(F.col("data"), F.lit("")))
    for c in TEXT_FIELDS:
        df = redact(df, c, hits=False).withColumnRenamed("had_secrets", f"__s_{c}")
    df = df.withColumn("has_secrets", F.col("__s_tool_input") | F.col("__s_tool_output") | F.col("__s_user_prompt") | F.col("__s_raw"))
    df = df.drop(*[f"__s_{c}" for c in TEXT_FIELDS])
    # An absent input stays absent after the redaction made it an empty text.
    df = df.withColumn("tool_input", F.nullif("tool_input", F.lit("")))
    return df.withColumn("dedup_key", F.coalesce(_key(strict), F.lit(""))).withColumn("modality", modality(F.col("raw")))


def ensure_sessions(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Insert-if-absent: the first event of a session gives its project, cwd and start."""
    first = events.groupBy("session_id").agg(F.min(F.struct("ts", "project", "cwd")).alias("f"))
    new = first.select(
        F.col("session_id").alias("id"), F.col("f.project").alias("project"), F.col("f.cwd").alias("cwd"),
        F.lit("active").alias("status"), F.col("f.ts").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"),
    )
    if sessions is None:
        return new
    return sessions.unionByName(new.join(sessions.select("id"), "id", "left_anti"), allowMissingColumns=True)


def end_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Mark sessions completed; the first end time stays. ``ends(session_id, ended_at)``."""
    first = ends.groupBy(F.col("session_id").alias("id")).agg(F.min("ended_at").alias("__end"))
    return (
        sessions.join(first, "id", "left")
        .withColumn("status", F.when(F.col("__end").isNotNull(), "completed").otherwise(F.col("status")))
        .withColumn("ended_at", F.coalesce("ended_at", "__end"))
        .drop("__end")
    )


def capture(events: DataFrame, seconds: float = 300, strict: bool = False) -> Captured:
    """Validate -> redact -> sessions -> dedup -> modality. ``events(hook_type, session_id, project, cwd, ts, data)``.

    The dedup window runs on event time. With ``strict`` the hook type and the prompt are part of the key too.
    """
    checked = validate_hooks(events)
    good = checked.filter("reject_reason IS NULL").drop("reject_reason")
    ended = good.filter(F.col("hook_type") == "session_end").select("session_id", F.col("ts").alias("ended_at"))
    # The same event sent twice has the same id. Only then the expensive columns: the dedup branch computes just its key.
    single = with_event_id(good.filter(F.col("hook_type") != "session_end")).dropDuplicates(["id"])
    ready = prepare(single, strict)
    kept = dedup_window(ready, ["session_id", "dedup_key"], "ts", "id", seconds, crowd=good).filter("NOT is_duplicate")
    observations = kept.select(
        "id", "session_id", "project", "hook_type", "tool_name", "tool_input", "tool_output", "user_prompt",
        "raw", "modality", "has_secrets", F.col("ts").alias("created_at"),
    )
    sessions = end_sessions(ensure_sessions(good), ended)
    return Captured(observations, checked.filter("reject_reason IS NOT NULL"), sessions, ended)


def apply_compression(observations: DataFrame, compressed: DataFrame) -> DataFrame:
    """Overwrite the compressed fields of matching observations and set ``compressed``."""
    fields = ["type", "title", "subtitle", "facts", "narrative", "concepts", "files", "importance", "confidence"]
    new = compressed.select("id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = observations.join(new, "id", "left")
    for c in fields:
        old = F.col(c) if c in observations.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("__new"), F.col(f"__{c}")).otherwise(old))
    was = F.col("compressed") if "compressed" in observations.columns else F.lit(False)
    return joined.withColumn("compressed", F.coalesce(F.col("__new"), was)).drop("__new", *[f"__{c}" for c in fields])


def observation_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("session_id").agg(F.count(F.lit(1)).alias("observation_count"))


def session_lifecycle(events: DataFrame, now, stuck_hours: int = 48) -> DataFrame:
    """Start, last event and end of every session, and whether it is stuck: open for longer than ``stuck_hours``."""
    ends = F.min(F.when(F.col("hook_type") == "session_end", F.col("ts")))
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(stuck_hours))
    return (
        events.groupBy("session_id")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), ends.alias("ended_at"), F.count(F.lit(1)).alias("events"))
        .withColumn("status", F.when(F.col("ended_at").isNotNull(), "completed").otherwise("active"))
        .withColumn("stuck", F.col("ended_at").isNull() & (F.col("started_at") < limit))
    )
