"""Profiles, recurring patterns, skills and operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import base_name, fnv1a_hex, sorted_pair
from memspark.operators.ranking import top_per_group, with_project


def _top_values(obs: DataFrame, array_col: str, out: str, top: int) -> DataFrame:
    counted = obs.select("project", F.explode(array_col).alias(out)).filter(F.col(out) != "").groupBy("project", out).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, ["project"], [F.desc("n"), F.asc(out)], top)


def profile_concepts(observations: DataFrame, top: int = 20) -> DataFrame:
    return _top_values(observations.filter("compressed"), "concepts", "concept", top)


def profile_files(observations: DataFrame, top: int = 20) -> DataFrame:
    return _top_values(observations.filter("compressed"), "files", "file", top)


def profile_types(memories: DataFrame) -> DataFrame:
    return memories.groupBy("project", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def profile_totals(observations: DataFrame, memories: DataFrame) -> DataFrame:
    """Observations and memories per project."""
    both = observations.filter("compressed").select("project", F.lit(1).alias("o"), F.lit(0).alias("m")).unionByName(
        memories.select("project", F.lit(0).alias("o"), F.lit(1).alias("m"))
    )
    return both.groupBy("project").agg(F.sum("o").alias("total_observations"), F.sum("m").alias("total_memories"))


def pattern_mentions(obs: DataFrame) -> DataFrame:
    """Every concept pair (both orders as one) and file -> concept pair of an observation, repeats kept, with ``pos``.

    Positions i < j of one row's own short lists; a row's pairs never leave its task.
    """
    empty = F.array().cast("array<string>")
    concepts, files = F.coalesce("concepts", empty), F.coalesce("files", empty)

    def after(i: Column) -> Column:
        return F.slice(concepts, i + 2, F.size(concepts) - i - 1)

    pairs = F.flatten(
        F.transform(concepts, lambda a, i: F.when(i + 1 < F.size(concepts), F.transform(after(i), lambda b: sorted_pair(a, b))).otherwise(empty))
    )
    linked = F.flatten(F.transform(files, lambda f: F.transform(concepts, lambda c: F.concat(base_name(f), F.lit(" → "), c))))
    return obs.select("project", "id", "title", "created_at", F.posexplode(F.concat(pairs, linked)).alias("pos", "pattern"))


def detect_patterns(observations: DataFrame, recent: int | None = None, min_count: int = 2, examples: int = 3, limit: int = 20, project: str | None = None, now=None) -> DataFrame:
    """Most frequent patterns of each project's observations, or of its latest ``recent``: (id, project, pattern, n, rank, examples, last_seen)."""
    newest = [F.desc("created_at"), F.asc("id")]
    slim = with_project(observations, project).filter("compressed").select("project", "id", "title", "created_at", "concepts", "files")
    latest = slim if recent is None else top_per_group(slim, ["project"], newest, recent, "__recent", spread=F.col("id")).drop("__recent")
    mentions = pattern_mentions(latest)
    counted = mentions.groupBy("project", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    best = top_per_group(counted, ["project"], [F.desc("n"), F.asc("pattern")], limit)
    shown = top_per_group(mentions.join(best.select("project", "pattern"), ["project", "pattern"], "left_semi"), ["project", "pattern"], [*newest, F.asc("pos")], examples, "ex")
    listed = shown.groupBy("project", "pattern").agg(F.array_sort(F.collect_list(F.struct("ex", "id", "title"))).alias("e"))
    return best.join(listed, ["project", "pattern"]).select(
        F.concat(F.lit("pat-"), fnv1a_hex(F.concat_ws(":", "project", "pattern"))).alias("id"), "project", "pattern", "n", "rank",
        F.transform("e", lambda x: F.struct(x["id"].alias("obs_id"), x["title"].alias("title"))).alias("examples"),
        F.lit(now).cast("timestamp").alias("last_seen"),
    )


def upsert_patterns(patterns: DataFrame, found: DataFrame) -> DataFrame:
    """By id: the larger count, new examples and time; patterns only on one side stay."""
    keep = ["id", "project", "pattern", "n", "examples", "last_seen"]
    old = patterns.select(*[F.col(c).alias(c if c == "id" else f"o_{c}") for c in keep])
    both = old.join(found.select(keep), "id", "full_outer")
    return both.select(
        "id", F.coalesce("o_project", "project").alias("project"), F.coalesce("o_pattern", "pattern").alias("pattern"),
        F.greatest("o_n", "n").alias("n"), F.coalesce("examples", "o_examples").alias("examples"), F.coalesce("last_seen", "o_last_seen").alias("last_seen"),
    )


def skill_level(evidence: Column) -> Column:
    return F.when(evidence >= 10, "expert").when(evidence >= 3, "competent").otherwise("novice")


def skills_rollup(evidence: DataFrame) -> DataFrame:
    """``evidence(project, skill_name, demonstrated_at)`` -> count, last time and level per skill."""
    counted = evidence.groupBy("project", "skill_name").agg(F.count(F.lit(1)).alias("evidence_count"), F.max("demonstrated_at").alias("last_demonstrated"))
    return counted.withColumn("level", skill_level(F.col("evidence_count")))


def observation_counters(observations: DataFrame) -> DataFrame:
    return observations.groupBy("project", "hook_type", "status").agg(F.count(F.lit(1)).alias("n"))


def dedup_counters(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_duplicate").groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def redaction_counters(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("hit_patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def eviction_counters(evicted: DataFrame) -> DataFrame:
    return evicted.groupBy(F.col("evicted_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


LATENCY_BUCKETS = 12


def latency_histogram(query_log: DataFrame, seconds: str = "seconds", first: float = 0.001) -> DataFrame:
    """Cumulative counts per mode in 12 buckets that start at 1 ms and double, and a last one for everything."""
    bounds = [first * 2**i for i in range(LATENCY_BUCKETS)]
    counts = [F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = query_log.groupBy("mode").agg(*counts, F.count(F.lit(1)).alias("b_all"), F.sum(seconds).alias("total_seconds"))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n")))
    return wide.select("mode", "total_seconds", F.inline(F.array(*cells)))
