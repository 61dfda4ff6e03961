"""Deletion with an audit trail, sharing, and audit queries. Tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import stable_id
from memspark.operators.placing import rank_rows
from memspark.operators.ranking import with_project

#: Rows that the newest of an audit are picked from within one task.
FEW_ROWS = 10_000


def audit_rows(rows: DataFrame, actor: Column, action: str, target_type: str, target: Column, payload: Column, now) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return rows.select(
        stable_id("aud", at, actor, F.lit(action), target, F.coalesce(payload, F.lit(""))).alias("id"), at.alias("ts"), actor.alias("actor"), F.lit(action).alias("action"),
        F.lit(target_type).alias("target_type"), target.alias("target_id"), payload.alias("payload"),
    )


def governance_delete(memories: DataFrame, requests: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``requests(memory_id, reason, actor)`` -> (kept, audit rows, rejected). Requests without a reason are rejected;
    every accepted request is audited, also for an id that does not exist."""
    valid = (F.coalesce("memory_id", F.lit("")) != "") & (F.coalesce("reason", F.lit("")) != "")
    named = requests.withColumn("actor", F.coalesce(F.nullif(F.col("actor"), F.lit("")), F.lit("governance")))
    accepted = named.filter(valid)
    payload = F.to_json(F.struct("actor", "reason"))
    audit = audit_rows(accepted, F.col("actor"), "governance_delete", "memory", F.col("memory_id"), payload, now)
    kept = memories.join(accepted.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return kept, audit, named.filter(~valid)


def forget(memories: DataFrame, ids: DataFrame, now, actor: str = "user") -> tuple[DataFrame, DataFrame]:
    """``ids(memory_id)`` -> (kept, audit rows)."""
    distinct = ids.select("memory_id").distinct()
    audit = audit_rows(distinct, F.lit(actor), "delete", "memory", F.col("memory_id"), F.lit("{}"), now)
    return memories.join(distinct.select(F.col("memory_id").alias("id")), "id", "left_anti"), audit


def share_memories(shares: DataFrame, requests: DataFrame, memories: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``requests(memory_id, team_id, shared_by, mode, ts)`` -> (shares, new feed rows, audit rows, rejected).

    The mode defaults to read; unknown modes, missing ids and unknown memories are rejected. A later share of the same
    memory and team replaces mode and sharer and keeps the first time.
    """
    named = requests.withColumn("mode", F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit("read")))
    known = memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("__known"))
    checked = named.join(known, "memory_id", "left").withColumn(
        "reject_reason",
        F.when((F.coalesce("memory_id", F.lit("")) == "") | (F.coalesce("team_id", F.lit("")) == ""), "memoryId and team required")
        .when(~F.col("mode").isin("read", "edit"), "mode must be read or edit")
        .when(F.col("__known").isNull(), "memory not found"),
    ).drop("__known")
    good = checked.filter("reject_reason IS NULL").drop("reject_reason")
    stacked = shares.select("memory_id", "team_id", "shared_by", "mode", F.col("shared_at").alias("ts")).unionByName(good.select("memory_id", "team_id", "shared_by", "mode", "ts"))
    latest = F.max(F.struct("ts", "mode", "shared_by"))
    merged = stacked.groupBy("memory_id", "team_id").agg(latest.alias("l"), F.min("ts").alias("shared_at"))
    merged = merged.select("memory_id", "team_id", F.col("l.shared_by").alias("shared_by"), F.col("l.mode").alias("mode"), "shared_at")
    feed = good.select(
        stable_id("feed", F.col("memory_id"), F.col("team_id"), F.col("ts")).alias("id"), "team_id", "memory_id", "shared_by", F.col("ts").alias("shared_at")
    )
    audit = audit_rows(good, F.col("shared_by"), "share", "memory", F.col("memory_id"), F.to_json(F.struct("mode", F.col("team_id").alias("team"))), now)
    return merged, feed, audit, checked.filter("reject_reason IS NOT NULL")


def revoke_shares(shares: DataFrame, requests: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """``requests(memory_id, team_id, actor)`` -> (shares, audit rows)."""
    audit = audit_rows(requests, F.col("actor"), "revoke", "memory", F.col("memory_id"), F.to_json(F.struct(F.col("team_id").alias("team"))), now)
    return shares.join(requests.select("memory_id", "team_id").distinct(), ["memory_id", "team_id"], "left_anti"), audit


def team_feed(feed: DataFrame, memories: DataFrame, team: str, limit: int = 50) -> DataFrame:
    """Newest shares of a team with the shared memory, empty text when it is gone. The feed is cut before the join."""
    recent = feed.filter(F.col("team_id") == team).orderBy(F.desc("shared_at"), "memory_id").limit(limit)
    slim = memories.select(F.col("id").alias("memory_id"), "title", "content")
    return recent.join(slim, "memory_id", "left").withColumns({"title": F.coalesce("title", F.lit("")), "content": F.coalesce("content", F.lit(""))})


def audit_query(audit: DataFrame, action: str | None = None, actor: str | None = None, project: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first; the project is looked for in the payload text."""
    if action:
        audit = audit.filter(F.col("action") == action)
    if actor:
        audit = audit.filter(F.col("actor") == actor)
    if project:
        audit = audit.filter(F.contains("payload", F.lit(project)))
    newest = [F.desc("ts"), F.desc("id")]
    if limit <= FEW_ROWS:
        return audit.orderBy(*newest).limit(limit)
    # Spark's own limit holds all rows it gives in one task. Here rows are placed in ranges, oldest first, and the last places stay.
    placed = rank_rows(audit.withColumn("__all", F.lit(0)), "__all", ["ts", "id"], "__pos")
    return placed.filter(F.col("__pos") >= placed.agg(F.count(F.lit(1))).scalar() - limit).drop("__all", "__pos").orderBy(*newest)


def archive_messages(messages: DataFrame, conversations: DataFrame, now, ttl_days: int = 90, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop messages of conversations not updated for ``ttl_days`` -> (kept, report of both counts)."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days))
    stale = with_project(conversations, project).filter(F.col("updated_at") < limit).select(F.col("id").alias("conversation_id"))
    old = messages.join(stale, "conversation_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    report = stale.agg(F.count(F.lit(1)).alias("conversations")).select("conversations", old.scalar().alias("messages"))
    return messages.join(stale, "conversation_id", "left_anti"), report
