"""Decay, eviction, health checks and repair. Every function takes ``now``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

STRENGTH_DIGITS = 9
DECAYING_TIERS = ("semantic", "procedural")


def _ts(now) -> Column:
    return F.lit(now).cast("timestamp")


def _before(now, **parts: int) -> Column:
    return _ts(now) - F.make_dt_interval(**{k: F.lit(v) for k, v in parts.items()})


def decayed_strength(now, rate: float = 0.95, bonus: float = 0.05, strength: Column | None = None) -> Column:
    """Strength after decay since the later of creation and last retrieval; a later retrieval first adds the bonus."""
    s = F.col("strength") if strength is None else strength
    recalled = F.coalesce(F.col("last_retrieved_at") > F.col("created_at"), F.lit(False))
    base = F.when(recalled, F.col("last_retrieved_at")).otherwise(F.col("created_at"))
    days = F.greatest(F.lit(0.0), (F.unix_micros(_ts(now)) - F.unix_micros(base)) / 86_400_000_000)
    raised = F.when(recalled, F.least(F.lit(1.0), s + bonus)).otherwise(s)
    return F.greatest(F.lit(0.0), raised * F.pow(F.lit(rate), days))


def decay(memories: DataFrame, now, rate: float = 0.95, threshold: float = 0.1, bonus: float = 0.05, initial: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (kept, evicted, report). Only the latest semantic and procedural memories decay.

    Each run decays the stored strength, so nightly runs compound. ``initial`` names a column with the first strength for
    the closed form instead. One projection; both outputs and the report read it.
    """
    due = F.coalesce(F.col("tier").isin(*DECAYING_TIERS), F.lit(False)) & F.coalesce(F.col("is_latest"), F.lit(False))
    strength = decayed_strength(now, rate, bonus, F.col(initial) if initial else None)
    aged = memories.withColumn("__due", due).withColumn("__new", F.when(F.col("__due"), strength).otherwise(F.col("strength")))
    gone = F.col("__due") & (F.col("__new") < threshold)
    marked = aged.withColumn("__gone", gone)
    settle = lambda df: df.withColumn("strength", F.col("__new")).drop("__due", "__new", "__gone")
    report = marked.agg(
        F.count_if("__due").alias("evaluated"), F.count_if("__gone").alias("evicted"),
        F.count_if(F.col("__due") & ~F.col("__gone")).alias("updated_strength"),
    )
    return settle(marked.filter("NOT __gone")), settle(marked.filter("__gone")), report


def review_band(memories: DataFrame, low: float = 0.1, high: float = 0.3) -> DataFrame:
    return memories.filter(F.col("strength").between(low, high))


def evict_observations(observations: DataFrame, sessions: DataFrame, now, working_hours: int = 24, episodic_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """-> (kept, evicted with a ``tier``). Raw rows age out after a day, compressed ones of unfinished sessions after seven."""
    open_sessions = sessions.filter(F.col("status") != "completed").select(F.col("id").alias("session_id"), F.lit(True).alias("__open"))
    joined = observations.join(open_sessions, "session_id", "left")
    working = ~F.col("compressed") & (F.col("created_at") < _before(now, hours=working_hours))
    episodic = F.col("compressed") & (F.col("created_at") < _before(now, days=episodic_days)) & F.col("__open")
    marked = joined.withColumn("evicted_tier", F.when(working, "working").when(episodic, "episodic")).drop("__open")
    return marked.filter("evicted_tier IS NULL").drop("evicted_tier"), marked.filter("evicted_tier IS NOT NULL")


def decay_report(memories: DataFrame, observations: DataFrame, sessions: DataFrame, now, **decay_args) -> DataFrame:
    """One row: evaluated, evicted, updated_strength, working_evicted, episodic_evicted."""
    _, _, counts = decay(memories, now, **decay_args)
    _, gone = evict_observations(observations, sessions, now)
    tiers = gone.agg(
        F.count_if(F.col("evicted_tier") == "working").alias("working_evicted"),
        F.count_if(F.col("evicted_tier") == "episodic").alias("episodic_evicted"),
    )
    one = lambda name: tiers.select(name).scalar().alias(name)
    return counts.select("*", one("working_evicted"), one("episodic_evicted"))


def decay_lessons(lessons: DataFrame, rate: float = 0.95, threshold: float = 0.1, project: str | None = None) -> DataFrame:
    """Multiply by the rate once, drop what falls below the threshold; other projects stay as they are."""
    mine = F.lit(True) if not project else F.col("project") == project
    aged = lessons.withColumn("strength", F.when(mine, F.col("strength") * rate).otherwise(F.col("strength")))
    return aged.filter(~mine | (F.col("strength") >= threshold))


def diagnose(sessions: DataFrame, observations: DataFrame, memories: DataFrame, indexed_docs: DataFrame, vectors: DataFrame, now, stuck_hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """-> (stats: one row, issues: component, severity, message, fixable, n)."""
    stuck_if = (F.col("status") == "active") & (F.col("started_at") < _before(now, hours=stuck_hours))
    ids = sessions.select(F.col("id").alias("session_id"))
    # One small aggregate per table; their rows meet in one last row.
    counted = {
        "sessions": (sessions, F.lit(True)), "stuck_sessions": (sessions, stuck_if), "observations": (observations, F.lit(True)),
        "compressed": (observations, F.col("compressed")), "memories": (memories, F.lit(True)), "indexed_docs": (indexed_docs, F.lit(True)),
        "vector_docs": (vectors, F.lit(True)), "orphaned_observations": (observations.join(ids, "session_id", "left_anti"), F.lit(True)),
    }
    rows = [df.agg(F.count_if(keep).alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, keep) in counted.items()]
    stats = reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted])
    stats = stats.withColumn("uncompressed", F.col("observations") - F.col("compressed"))

    def issue(component: str, n: Column, found: Column, message: Column) -> Column:
        return F.when(
            found,
            F.struct(F.lit(component).alias("component"), F.lit("warning").alias("severity"), message.alias("message"), F.lit(True).alias("fixable"), n.cast("bigint").alias("n")),
        )

    unindexed = (F.col("compressed") > 0) & (F.col("indexed_docs") == 0)
    issues = F.array_compact(
        F.array(
            issue("bm25_index", F.col("compressed"), unindexed, F.concat(F.col("compressed"), F.lit(" compressed observations but no indexed document"))),
            issue("sessions", F.col("stuck_sessions"), F.col("stuck_sessions") > 0, F.concat(F.col("stuck_sessions"), F.lit(f" sessions active for more than {stuck_hours} h"))),
            issue("observations", F.col("orphaned_observations"), F.col("orphaned_observations") > 0, F.concat(F.col("orphaned_observations"), F.lit(" observations without a session"))),
        )
    )
    # An index without documents makes the store unhealthy, the other warnings do not.
    stats = stats.withColumn("healthy", ~unindexed)
    return stats, stats.select(F.inline(issues))


def heal(sessions: DataFrame, observations: DataFrame, dedup_marks: DataFrame, now, stuck_hours: int = 48, dedup_minutes: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Abandon stuck sessions, drop orphans, prune old dedup marks -> (sessions, observations, marks, report)."""
    stuck = (F.col("status") == "active") & (F.col("started_at") < _before(now, hours=stuck_hours))
    old_mark = F.col("seen_at") < _before(now, mins=dedup_minutes)
    ids = sessions.select(F.col("id").alias("session_id"))
    healed = sessions.withColumn("ended_at", F.when(stuck, _ts(now)).otherwise(F.col("ended_at"))).withColumn(
        "status", F.when(stuck, "abandoned").otherwise(F.col("status"))
    )
    kept = observations.join(ids, "session_id", "left_semi")
    orphans = observations.join(ids, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    report = sessions.agg(F.count_if(stuck).alias("sessions_abandoned")).select(
        "sessions_abandoned", orphans.scalar().alias("observations_removed"),
        dedup_marks.agg(F.count_if(old_mark).alias("n")).scalar().alias("dedup_marks_pruned"),
    )
    return healed, kept, dedup_marks.filter(~old_mark), report
