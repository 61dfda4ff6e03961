"""Prompt context for a table of requests, assembled from every store in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import token_estimate, truncate_dots
from memspark.operators.matching import substring_pairs
from memspark.operators.ranking import top_per_group

MIN_SLOT_SECTION = 20


def top_by_scope(table: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The best ``k`` rows of each project, and of all projects under the empty project."""
    best = top_per_group(table, ["project"], order, k)
    overall = top_per_group(best.withColumn("q_project", F.lit("")), ["q_project"], order, k)
    return best.withColumn("q_project", F.col("project")).filter("q_project <> ''").unionByName(overall)


def top_matches(requests: DataFrame, table: DataFrame, text: Column, order: list[Column], k: int) -> DataFrame:
    """(request_id, rank, ...row): best ``k`` rows of the request's project whose text contains its query.

    Works on distinct texts and distinct (project, query) pairs; of equal texts in a project only ``k`` rows can matter.
    """
    table = table.withColumn("__text", F.lower(text))
    best = top_per_group(table, ["project", "__text"], order, k).drop("rank")
    asked = requests.select(F.coalesce("project", F.lit("")).alias("q_project"), F.lower(F.coalesce("query", F.lit(""))).alias("needle")).distinct()
    named = asked.filter("needle <> ''")
    pairs = substring_pairs(named, table, text_col="__text").withColumnRenamed("text", "__text")
    found = named.join(pairs, "needle").join(best, "__text").filter((F.col("q_project") == "") | (F.col("q_project") == F.col("project")))
    plain = asked.filter("needle = ''").join(top_by_scope(best, order, k).drop("rank"), "q_project")
    top = top_per_group(found.unionByName(plain.select(found.columns)), ["q_project", "needle"], order, k)
    keyed = requests.select("request_id", F.coalesce("project", F.lit("")).alias("q_project"), F.lower(F.coalesce("query", F.lit(""))).alias("needle"))
    return keyed.join(top, ["q_project", "needle"])


def _section(rows: DataFrame, line: Column, head: str, name: str) -> DataFrame:
    """Bounded ranked rows -> (request_id, text, n)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return (
        rows.select("request_id", "rank", line.alias("line")).groupBy("request_id")
        .agg(F.concat(F.lit(f"## {head}\n"), F.array_join(lines, "")).alias(f"{name}_text"), F.count(F.lit(1)).alias(f"n_{name}"))
    )


SOURCES = ("memories", "preferences", "facts", "messages", "traces", "slots")


def assemble_context(
    requests: DataFrame,
    memories: DataFrame | None = None,
    preferences: DataFrame | None = None,
    facts: DataFrame | None = None,
    messages: DataFrame | None = None,
    traces: DataFrame | None = None,
    slots: DataFrame | None = None,
    max_items: int = 10,
    recent_messages: bool = False,
) -> DataFrame:
    """``requests(request_id, project, session_id, query)`` -> context, token_estimate and rows per source.

    A source that is not given is left out. Messages are the session's oldest unless ``recent_messages``.
    """
    n, half = max_items, max_items // 2
    scope = F.coalesce("project", F.lit("")).alias("q_project")
    sections: dict[str, DataFrame] = {}
    if memories is not None:
        best = top_by_scope(memories.filter("tier = 'semantic'"), [F.desc("strength"), F.desc("created_at"), F.asc("id")], n)
        rows = requests.select("request_id", scope).join(best, "q_project")
        line = F.format_string("- **%s**: %s\n", "title", truncate_dots(F.col("content"), 200))
        sections["memories"] = _section(rows, line, "Memories", "memories")
    if preferences is not None:
        rows = top_matches(
            requests, preferences.filter("superseded_by IS NULL"), F.col("preference"),
            [F.desc("confidence"), F.desc("created_at"), F.asc("id")], half,
        )
        sections["preferences"] = _section(rows, F.format_string("- [%s] %s\n", "category", "preference"), "Preferences", "preferences")
    if facts is not None:
        text = F.concat_ws(" ", "subject", "predicate", "object_val")
        rows = top_matches(requests, facts, text, [F.desc("confidence"), F.asc("id")], half)
        sections["facts"] = _section(rows, F.format_string("- %s %s %s\n", "subject", "predicate", "object_val"), "Facts", "facts")
    if messages is not None:
        by_time = [F.desc("created_at"), F.desc("id")] if recent_messages else [F.asc("created_at"), F.asc("id")]
        best = top_per_group(messages, ["session_id"], by_time, n)
        best = best.withColumn("rank", -F.col("rank")) if recent_messages else best
        rows = requests.filter(F.coalesce("session_id", F.lit("")) != "").select("request_id", "session_id").join(best, "session_id")
        line = F.format_string("**%s**: %s\n", "role", truncate_dots(F.col("content"), 300))
        sections["messages"] = _section(rows, line, "Recent Conversation", "messages")
    if traces is not None:
        asked = requests.filter(F.coalesce("query", F.lit("")) != "")
        rows = top_matches(asked, traces, F.col("task"), [F.desc("started_at"), F.asc("id")], half)
        outcome = F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.lit("in progress"))
        line = F.format_string("- Task: %s → %s\n", "task", truncate_dots(outcome, 100))
        sections["traces"] = _section(rows, line, "Past Reasoning", "traces")
    if slots is not None:
        # Pinned slots are unique per project and name and always shown whole: one text per project, joined to requests.
        both = slots.withColumn("q_project", F.col("project")).filter("q_project <> ''").unionByName(slots.withColumn("q_project", F.lit("")))
        wanted = both.join(requests.select(scope).distinct(), "q_project")
        line = F.when(F.coalesce("content", F.lit("")) != "", F.format_string("### %s\n%s\n", "slot_name", truncate_dots(F.col("content"), 500)))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("slot_name", "project", line.alias("line")))), lambda x: F.coalesce(x["line"], F.lit("")))
        pinned = wanted.groupBy("q_project").agg(F.concat(F.lit("## Pinned Context\n"), F.array_join(lines, "")).alias("slots_text"), F.count(F.lit(1)).alias("n_slots"))
        pinned = pinned.filter(F.octet_length("slots_text") > MIN_SLOT_SECTION)
        sections["slots"] = requests.select("request_id", scope).join(pinned, "q_project").select("request_id", "slots_text", "n_slots")
    out = requests
    for part in sections.values():
        out = out.join(part, "request_id", "left")
    used = [s for s in SOURCES if s in sections]
    context = F.concat_ws("\n", *[F.col(f"{s}_text") for s in used])
    counts = [(F.coalesce(F.col(f"n_{s}"), F.lit(0)) if s in used else F.lit(0)).cast("bigint").alias(f"n_{s}") for s in SOURCES]
    out = out.withColumn("context", context)
    return out.select(*requests.columns, "context", token_estimate(F.col("context")).alias("token_estimate"), *counts)
