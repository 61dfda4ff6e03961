"""Lookups, timelines, text searches and joined views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memspark.functions.text import contains_ci
from memspark.operators.ranking import top_per_group, with_project
from memspark.sources.tables import spread


def by_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Point reads for a table of keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def timeline(obs: DataFrame, project=None, session=None, hook=None, file=None, after=None, before=None, limit: int = 50) -> DataFrame:
    """Oldest first; both time bounds exclusive; only the given filters are added."""
    if project:
        obs = obs.filter(F.col("project") == project)
    if session:
        obs = obs.filter(F.col("session_id") == session)
    if hook:
        obs = obs.filter(F.col("hook_type") == hook)
    if after:
        obs = obs.filter(F.col("created_at") > F.lit(after).cast("timestamp"))
    if before:
        obs = obs.filter(F.col("created_at") < F.lit(before).cast("timestamp"))
    if file:
        obs = obs.filter(F.array_contains("files", file))
    return obs.orderBy("created_at", "id").limit(limit)


def file_history(obs: DataFrame, file: str, project: str | None = None, limit: int = 50) -> DataFrame:
    return with_project(obs, project).filter(F.col("compressed") & F.array_contains("files", file)).orderBy("created_at", "id").limit(limit)


def list_observations(obs: DataFrame, project=None, session=None, limit: int = 50) -> DataFrame:
    obs = with_project(obs, project)
    obs = obs.filter(F.col("session_id") == session) if session else obs
    return obs.orderBy(F.desc("created_at"), "id").limit(limit)


def list_sessions(sessions: DataFrame, project=None, status=None, limit: int = 50) -> DataFrame:
    sessions = with_project(sessions, project)
    sessions = sessions.filter(F.col("status") == status) if status else sessions
    return sessions.orderBy(F.desc("started_at"), "id").limit(limit)


def list_actions(actions: DataFrame, project=None, status=None, limit: int | None = 50) -> DataFrame:
    actions = with_project(actions, project)
    actions = actions.filter(F.col("status") == status) if status else actions
    ordered = actions.orderBy("priority", "created_at", "id")
    return ordered if limit is None else ordered.limit(limit)


def list_slots(slots: DataFrame, project=None) -> DataFrame:
    return with_project(slots, project).orderBy("project", "slot_name")


def memories_by_tier(memories: DataFrame, tier=None, project=None, limit: int = 50) -> DataFrame:
    memories = with_project(memories, project)
    memories = memories.filter(F.col("tier") == tier) if tier else memories
    return memories.orderBy(F.desc("strength"), F.desc("created_at"), "id").limit(limit)


def latest_memories(memories: DataFrame, project=None, limit: int = 25) -> DataFrame:
    return with_project(memories, project).filter("is_latest").orderBy(F.desc("strength"), "id").limit(limit)


def text_search(table: DataFrame, fields: list[Column], text: str, order: list[Column], limit: int, project: str | None = None) -> DataFrame:
    """Rows with ``text`` in any of the fields, case folded, no wildcards; an empty text matches all."""
    table = with_project(table, project)
    if text:
        table = table.filter(reduce(lambda a, b: a | b, [contains_ci(f, text) for f in fields]))
    return table.orderBy(*order).limit(limit)


def search_memories(memories, text, project=None, limit=10):
    return text_search(memories, [F.col("title"), F.col("content")], text, [F.desc("strength"), F.asc("id")], limit, project)


def search_messages(messages, text, project=None, limit=20):
    return text_search(messages, [F.col("content")], text, [F.desc("created_at"), F.asc("id")], limit, project)


def search_preferences(preferences, text="", category=None, project=None, limit=20):
    live = preferences.filter("superseded_by IS NULL")
    live = live.filter(F.col("category") == category) if category else live
    return text_search(live, [F.col("preference")], text, [F.desc("confidence"), F.desc("created_at"), F.asc("id")], limit, project)


def search_facts(facts, text="", subject=None, predicate=None, project=None, limit=20):
    facts = facts.filter(F.col("subject") == subject) if subject else facts
    facts = facts.filter(F.col("predicate") == predicate) if predicate else facts
    whole = F.concat_ws(" ", "subject", "predicate", "object_val")
    return text_search(facts, [whole], text, [F.desc("confidence"), F.asc("id")], limit, project)


def search_traces(traces, text, project=None, limit=20):
    return text_search(traces, [F.col("task")], text, [F.desc("started_at"), F.asc("id")], limit, project)


def search_lessons(lessons, text, project=None, limit=20):
    return text_search(lessons, [F.col("lesson")], text, [F.desc("strength"), F.desc("created_at"), F.asc("id")], limit, project)


def search_skills(skills, text, project=None, limit=20):
    return text_search(skills, [F.col("skill_name")], text, [F.desc("evidence_count"), F.asc("project"), F.asc("skill_name")], limit, project)


def list_patterns(patterns, project=None, limit=20):
    return with_project(patterns, project).orderBy(F.desc("n"), "pattern", "project").limit(limit)


def locations_near(locations: DataFrame, lat: float, lon: float, radius_km: float = 5, project=None, limit: int = 20) -> DataFrame:
    """Locations in the box of half-width radius/111 degrees around a point."""
    d = radius_km / 111.0
    near = with_project(locations, project).filter(
        (F.col("type") == "LOCATION") & F.col("latitude").between(lat - d, lat + d) & F.col("longitude").between(lon - d, lon + d)
    )
    return near.orderBy(F.desc("confidence"), "id").limit(limit)


def locations_near_points(points: DataFrame, locations: DataFrame, radius_km: float = 5, limit: int = 20) -> DataFrame:
    """The same for a table ``points(point_id, lat, lon)``.

    A grid of cells as wide as the box turns the range join into an equi-join: a box meets at most four cells. Points in
    one place share their box, and of locations in one place only the first ``limit`` can be among a point's, so neither
    table's copies of a place meet each other.
    """
    d = radius_km / 111.0
    cell = lambda c: F.floor(c / (2 * d)).cast("bigint")
    order = [F.desc("confidence"), F.asc("location_id")]
    spots = locations.filter((F.col("type") == "LOCATION") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("id").alias("location_id"), "name", "confidence", "latitude", "longitude"
    )
    spots = top_per_group(spread(spots), ["latitude", "longitude"], order, limit).drop("rank")
    spots = spots.withColumns({"cy": cell(F.col("latitude")), "cx": cell(F.col("longitude"))})
    places = spread(points.select("lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct())
    box = (
        places.select("lat", "lon", F.explode(F.sequence(cell(F.col("lat") - d), cell(F.col("lat") + d))).alias("cy"))
        .withColumn("cx", F.explode(F.sequence(cell(F.col("lon") - d), cell(F.col("lon") + d))))
    )
    hits = box.join(spots, ["cy", "cx"]).filter(
        F.col("latitude").between(F.col("lat") - d, F.col("lat") + d) & F.col("longitude").between(F.col("lon") - d, F.col("lon") + d)
    )
    best = top_per_group(hits, ["lat", "lon"], order, limit).drop("rank")
    found = spread(points.select("point_id", "lat", "lon")).join(best, ["lat", "lon"])
    return top_per_group(found, ["point_id"], order, limit).select("point_id", "location_id", "name", "confidence", "rank")


def query_facets(memories: DataFrame, facets: DataFrame, wanted: list[tuple[str, str]], project=None, limit: int = 20) -> DataFrame:
    """Memories that carry every wanted (dimension, value) pair; without pairs the strongest memories."""
    memories = with_project(memories, project)
    if wanted:
        pairs = sorted(set(wanted))
        pick = reduce(lambda a, b: a | b, [(F.col("dimension") == d) & (F.col("value") == v) for d, v in pairs])
        full = (
            facets.filter(pick).select("memory_id", "dimension", "value").distinct()
            .groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(pairs))
        )
        memories = memories.join(full.select(F.col("memory_id").alias("id")), "id", "left_semi")
    return memories.orderBy(F.desc("strength"), "id").limit(limit)


def conversation_view(messages: DataFrame, limit: int = 200) -> DataFrame:
    """Messages of each session in order, numbered from 1, the first ``limit``."""
    return top_per_group(messages, ["session_id"], [F.asc("created_at"), F.asc("id")], limit, "pos")


def number_steps(steps: DataFrame, order: list[str]) -> DataFrame:
    """Add ``step_index`` from 0 per trace.

    The index of a step is the number of steps before it. Steps are counted per trace and time slice first, so the window
    over a trace sees one row per slice and a long trace is numbered by many tasks.
    """
    slice_of = F.floor(F.unix_micros(F.col(order[0])) / 60_000_000)
    sliced = steps.withColumn("__slice", slice_of)
    counts = sliced.groupBy("trace_id", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("trace_id").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = W.partitionBy("trace_id", "__slice").orderBy(*order)
    numbered = sliced.withColumn("__rn", F.row_number().over(within)).join(offsets, ["trace_id", "__slice"])
    return numbered.withColumn("step_index", (F.col("__before") + F.col("__rn") - 1).cast("int")).drop("__slice", "__rn", "__before")


def trace_tree(traces: DataFrame, steps: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Trace -> step -> tool calls in long form, one row per step and call; traces and steps without children stay."""
    s = steps.select("trace_id", F.col("id").alias("step_id"), "step_index", "thought", "action")
    c = tool_calls.select("step_id", F.col("id").alias("call_id"), "tool_name", F.coalesce(F.nullif("status", F.lit("")), F.lit("success")).alias("call_status"))
    return traces.select(F.col("id").alias("trace_id"), "task").join(s, "trace_id", "left").join(c, "step_id", "left")


def status_report(sessions: DataFrame, observations: DataFrame, memories: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name)
    return sessions.agg(F.count(F.lit(1)).alias("sessions")).select("sessions", count(observations, "observations"), count(memories, "memories"))


def mark_retrieved(memories: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Stamp ``last_retrieved_at`` with the latest of a log (memory_id, ts)."""
    latest = retrievals.groupBy(F.col("memory_id").alias("id")).agg(F.max("ts").alias("__ts"))
    return memories.join(latest, "id", "left").withColumn("last_retrieved_at", F.greatest("last_retrieved_at", "__ts")).drop("__ts")
