"""Change tables applied to stores: each function is old table + changes -> new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import auto_title, stable_id
from memspark.operators.duplicates import similar_memories
from memspark.operators.ranking import top_per_group


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add rows whose key is not there yet; among new rows of one key the first by ``order`` wins."""
    first = top_per_group(new, keys, order, 1, "__r").drop("__r")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_latest(table: DataFrame, changes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Per key the row with the latest time; a change beats an equally old stored row."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    latest = F.max(F.struct(ts, "__new", *[c for c in rest if c not in (ts, "__new")])).alias("l")
    return both.groupBy(*keys).agg(latest).select(*[c if c in keys else F.col(f"l.{c}").alias(c) for c in table.columns])


def ensure_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen(identifier, ts)``; existing users stay."""
    new = seen.filter(F.coalesce("identifier", F.lit("")) != "").groupBy("identifier").agg(F.min("ts").alias("created_at"))
    new = new.withColumn("id", stable_id("user", F.col("identifier")))
    return users.unionByName(new.join(users.select("identifier"), "identifier", "left_anti"), allowMissingColumns=True)


COPIES = 1000


def remember(memories: DataFrame, new: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``new(project, type, title, content, tier, strength)`` -> (memories, hints about similar ones, rejected).

    Defaults: type fact, tier semantic, a title from the first words, strength 1 for 0 or less. Content is required.
    Equal rows of one call are memories of their own; the same call again adds none.
    """
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    at = F.lit(now).cast("timestamp")
    valid = F.coalesce("content", F.lit("")) != ""
    rows = new.filter(valid).select(
        F.coalesce("project", F.lit("")).alias("project"), text("type", F.lit("fact")).alias("type"), text("tier", F.lit("semantic")).alias("tier"),
        text("title", auto_title(F.col("content"))).alias("title"), "content",
        F.when(F.coalesce("strength", F.lit(0.0)) <= 0, 1.0).otherwise(F.col("strength")).alias("strength"),
    )
    given = ["project", "type", "tier", "title", "content", "strength"]
    # Equal rows are told apart by a number, in two steps so that no array grows with their count.
    counted = rows.groupBy(*given).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPIES})")))
    copies = blocks.withColumn("__copy", F.explode(F.expr(f"sequence(__block * {COPIES}, least(__n, (__block + 1) * {COPIES}) - 1)")))
    named = stable_id("mem", F.col("project"), F.col("content"), F.col("title"), at, *[F.col(c) for c in ("type", "tier", "strength", "__copy")])
    rows = copies.select(named.alias("id"), *given, F.lit(True).alias("is_latest"), at.alias("created_at"), at.alias("updated_at"))
    fresh = rows.join(memories.select("id"), "id", "left_anti")
    return memories.unionByName(fresh, allowMissingColumns=True), similar_memories(rows, memories), new.filter(~valid)


def with_default_confidence(rows: DataFrame, col: str = "confidence") -> DataFrame:
    """Preferences and facts: a confidence of 0 or less means 1."""
    return rows.withColumn(col, F.when(F.coalesce(F.col(col), F.lit(0.0)) <= 0, 1.0).otherwise(F.col(col)))


def add_facets(facets: DataFrame, new: DataFrame) -> DataFrame:
    return insert_if_absent(facets, new, ["memory_id", "dimension", "value"], [F.asc("created_at")])


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Delete preferences, the messages of a session, the working memory of a session."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def set_slots(slots: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert_latest(slots, changes, ["project", "slot_name"], "updated_at")


def working_pop(stack: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """Take the ``n`` newest items of every session -> (popped, rest)."""
    popped = top_per_group(stack, ["session_id"], [F.desc("pushed_at"), F.desc("id")], max(n, 1))
    return popped, stack.join(popped.select("id"), "id", "left_anti")


def ensure_conversations(messages: DataFrame) -> DataFrame:
    """One conversation per session: created with its first message, updated with its last."""
    return messages.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("messages")).withColumn(
        "id", stable_id("conv", F.col("session_id"))
    )


def complete_traces(traces: DataFrame, completions: DataFrame) -> DataFrame:
    """``completions(trace_id, outcome, success, ts)``; the last one counts."""
    last = completions.groupBy(F.col("trace_id").alias("id")).agg(F.max(F.struct("ts", "outcome", "success")).alias("__c"))
    joined = traces.join(last, "id", "left")
    for col, field in (("outcome", "outcome"), ("success", "success"), ("completed_at", "ts")):
        old = F.col(col) if col in traces.columns else F.lit(None)
        joined = joined.withColumn(col, F.when(F.col("__c").isNotNull(), F.col(f"__c.{field}")).otherwise(old))
    return joined.drop("__c")
