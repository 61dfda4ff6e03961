"""Actions, their dependencies, sentinels and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memspark.functions.text import stable_id
from memspark.operators.ranking import top_per_group


def frontier(actions: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending actions whose dependencies all exist and are completed. ``deps(action_id, dep_id)``.

    An action is blocked by any dependency that is not a completed action: two anti-joins, no per-action grouping.
    """
    done = actions.filter("status = 'completed'").select("project", F.col("id").alias("dep_id"))
    pending = actions.filter("status = 'pending'")
    owned = deps.join(pending.select("project", F.col("id").alias("action_id")), "action_id")
    blocked = owned.join(done, ["project", "dep_id"], "left_anti").select("project", F.col("action_id").alias("id")).distinct()
    return pending.join(blocked, ["project", "id"], "left_anti")


def next_action(actions: DataFrame, deps: DataFrame) -> DataFrame:
    """First ready action of each project by priority, age and id."""
    return top_per_group(frontier(actions, deps), ["project"], [F.asc("priority"), F.asc("created_at"), F.asc("id")], 1).drop("rank")


def crystallize_lines(groups: DataFrame, actions: DataFrame) -> DataFrame:
    """(group_id, project, pos, action_id, title): what a group's summary is made of, in long form."""
    return groups.join(actions.select(F.col("id").alias("action_id"), "project", "title"), "action_id").select("group_id", "project", "pos", "action_id", "title")


SHOWN = 100


def crystallize(groups: DataFrame, actions: DataFrame, shown: int | None = SHOWN) -> DataFrame:
    """``groups(group_id, action_id, pos)`` -> one completed summary action per group; unknown ids are skipped.

    The description lists the titles of the first ``shown`` actions, so that a row doesn't grow with its group; None lists
    all, for groups known to be small. ``crystallize_lines`` has all in long form.
    """
    titled = crystallize_lines(groups, actions)
    if shown is not None:
        counted = titled.groupBy("group_id", "project").agg(F.count(F.lit(1)).alias("all"))
        titled = top_per_group(titled, ["group_id", "project"], [F.asc("pos"), F.asc("action_id")], shown).drop("rank").join(counted, ["group_id", "project"])
    number = F.count(F.lit(1)) if shown is None else F.max("all")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "action_id", "title"))), lambda x: x["title"])
    return titled.groupBy("group_id", "project").agg(number.alias("n"), F.array_join(lines, "; ").alias("description")).select(
        stable_id("cryst", F.col("project"), F.col("group_id")).alias("id"), "group_id", "project",
        F.format_string("Crystallized: %d actions", "n").alias("title"), "description", F.lit("completed").alias("status"), "n",
    )


def match_sentinels(sentinels: DataFrame, events: DataFrame) -> DataFrame:
    """First event of each sentinel's project that has the watched type; sentinels that never fire stay untriggered.

    Events are reduced to the first time per project and type before the join.
    """
    first = events.groupBy("project", F.col("event_type").alias("event_pattern")).agg(F.min("ts").alias("triggered_at"))
    return sentinels.join(first, ["project", "event_pattern"], "left")


def inbox(signals: DataFrame, to: str, project: str | None = None) -> DataFrame:
    signals = signals.filter(F.col("to") == to)
    signals = signals.filter(F.col("project") == project) if project else signals
    return signals.orderBy(F.desc("created_at"), "id")


def promote_sketch(sketches: DataFrame) -> DataFrame:
    """``sketches(sketch_id, project, pos, title)`` -> routine steps in long form."""
    return sketches.select(
        stable_id("routine", F.col("project"), F.col("sketch_id")).alias("routine_id"), "project",
        F.concat(F.lit("sketch-"), "sketch_id").alias("name"), "pos", F.col("title").alias("step"),
    )
