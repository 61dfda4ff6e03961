"""Session summaries and consolidation of sessions into memories, all sessions in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import clip, first_sentence, stable_id
from memspark.operators.capture import end_sessions
from memspark.operators.ranking import top_per_group

# What counts as a decision, and how much of a session is quoted unless asked otherwise.
DECISION = r"(?iU)\b(?:decide[ds]?\s+to|use|chose|chosen|adopt(?:ed)?|prefer)\b[^.!?\n]{4,160}"
LEAD_SENTENCE = r"^([^.!?]{8,200})[.!?]?"
MAX_DECISIONS = 10
MAX_CONCEPTS = 10
MAX_NARRATIVES = 20
BULLET = " • "


@dataclass(frozen=True)
class Summaries:
    """``summaries`` has one bounded row per session. ``files(session_id, file, first_at, first_id, first_pos)`` and, for
    the light style, ``sentences`` hold the lists that grow with a session, in long form."""

    summaries: DataFrame
    files: DataFrame
    sentences: DataFrame | None = None


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _listed(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Bounded rows (session_id, rank, value) -> one array per session in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", value)))
    return rows.groupBy("session_id").agg(F.transform(pairs, lambda p: p[value]).alias(out))


def top_concepts(obs: DataFrame, k: int | None = MAX_CONCEPTS) -> DataFrame:
    """(session_id, concept, n, rank): most frequent folded concepts, first seen first among equals."""
    rows = obs.select("session_id", "created_at", "id", F.posexplode("concepts").alias("pos", "c")).withColumn("concept", _strip(F.lower("c")))
    counted = (
        rows.filter("concept <> ''").groupBy("session_id", "concept")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "id", "pos")).alias("first"))
    )
    return top_per_group(counted, ["session_id"], [F.desc("n"), F.asc("first")], k)


def mine_decisions(obs: DataFrame, k: int | None = MAX_DECISIONS) -> DataFrame:
    """(session_id, decision, rank): the first ``k`` different decisions of a session, facts before the narrative of a row."""
    texts = F.concat(F.coalesce("facts", F.array().cast("array<string>")), F.array(F.coalesce("narrative", F.lit(""))))
    found = (
        obs.select("session_id", "created_at", "id", F.posexplode(texts).alias("src", "text"))
        .select("session_id", "created_at", "id", "src", F.posexplode(F.regexp_extract_all("text", F.lit(DECISION), F.lit(0))).alias("pos", "hit"))
        .withColumn("decision", F.btrim("hit", F.lit(" .,;:")))
    )
    first = (
        found.groupBy("session_id", F.lower("decision").alias("norm"))
        .agg(F.min(F.struct("created_at", "id", "src", "pos", "decision")).alias("first"))
    )
    best = top_per_group(first, ["session_id"], [F.asc("first")], k)
    return best.select("session_id", F.col("first.decision").alias("decision"), "rank")


def session_files(obs: DataFrame) -> DataFrame:
    """Every file of a session once, with its first appearance as sort key."""
    return (
        obs.select("session_id", "created_at", "id", F.posexplode("files").alias("pos", "file"))
        .groupBy("session_id", "file")
        .agg(F.min(F.struct("created_at", "id", "pos")).alias("f"))
        .select("session_id", "file", F.col("f.created_at").alias("first_at"), F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_pos"))
    )


def summarize_sessions(
    observations: DataFrame,
    style: str = "full",
    max_decisions: int | None = MAX_DECISIONS,
    max_concepts: int | None = MAX_CONCEPTS,
    max_quotes: int | None = MAX_NARRATIVES,
    title_chars: int = 120,
    narrative_chars: int = 2000,
) -> Summaries:
    """Summaries of the compressed observations of every session; sessions without any give no row.

    ``full``: title, narrative of the first 20 rows, decisions, concepts. ``light``: title and concepts, and the first
    sentence of every row as a table. The limits shape the bounded row, None meaning all; every concept and decision is in
    ``top_concepts(obs, None)`` and ``mine_decisions(obs, None)``, in long form.
    """
    obs = observations.filter("compressed")
    base = obs.groupBy("session_id").agg(F.min(F.struct("created_at", "id", "project", "title")).alias("f"), F.count(F.lit(1)).alias("observations"))
    base = base.select("session_id", F.col("f.project").alias("project"), F.col("f.title").alias("first_title"), "observations")
    concepts = _listed(top_concepts(obs, max_concepts), "concept", "concepts")
    out = base.join(concepts, "session_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    lead = F.get("concepts", F.lit(0))
    if style == "light":
        title = F.when(lead.isNotNull(), F.concat(F.lit("Session on "), lead)).otherwise(F.lit("Session"))
        sentences = obs.filter(F.coalesce("narrative", F.lit("")) != "").select(
            "session_id", "created_at", "id", first_sentence(F.col("narrative")).alias("sentence")
        )
        files = session_files(obs).filter("file <> ''")
        return Summaries(out.select("session_id", "project", title.alias("title"), "concepts", "observations"), files, sentences)
    first_rows = top_per_group(obs.select("session_id", "created_at", "id", "narrative"), ["session_id"], [F.asc("created_at"), F.asc("id")], max_quotes)
    quoted = first_rows.withColumn("s", _strip(F.regexp_extract(_strip(F.coalesce("narrative", F.lit(""))), LEAD_SENTENCE, 1)))
    # A lead of blanks only still counts as a (blank) quote, a missing one does not.
    quoted = quoted.filter(_strip(F.coalesce("narrative", F.lit(""))).rlike(LEAD_SENTENCE))
    narratives = _listed(quoted, "s", "quotes")
    decisions = _listed(mine_decisions(obs, max_decisions), "decision", "key_decisions")
    title = clip(_strip(F.concat(F.lit("Session on "), F.coalesce(lead, F.col("first_title")))), title_chars)
    joined = F.concat_ws(BULLET, "quotes")
    summaries = (
        out.join(narratives, "session_id", "left").join(decisions, "session_id", "left")
        .select(
            "session_id", "project", title.alias("title"),
            clip(F.when(F.coalesce(joined, F.lit("")) == "", "(no narratives)").otherwise(joined), narrative_chars).alias("narrative"),
            F.coalesce("key_decisions", F.array().cast("array<string>")).alias("key_decisions"), "concepts", "observations",
        )
    )
    return Summaries(summaries, session_files(obs))


@dataclass(frozen=True)
class Consolidated:
    """``memories`` carry their ``session_id``; files and source observations of a memory are those of its session."""

    summaries: DataFrame
    memories: DataFrame
    sessions: DataFrame
    files: DataFrame
    sources: DataFrame


def consolidate(observations: DataFrame, sessions: DataFrame, now) -> Consolidated:
    """One workflow memory per session and one architecture memory per decision; summarized sessions are completed."""
    done = summarize_sessions(observations)
    at = F.lit(now).cast("timestamp")
    common = [
        F.lit("semantic").alias("tier"), "concepts", F.lit(1.0).alias("strength"), F.lit(True).alias("is_latest"),
        at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("timestamp").alias("last_retrieved_at"),
    ]
    summary = done.summaries
    whole = summary.select(
        stable_id("mem", F.col("session_id"), F.lit("summary")).alias("id"), "session_id", "project", F.lit("workflow").alias("type"),
        "title", F.col("narrative").alias("content"), *common,
    )
    parts = summary.select("session_id", "project", "concepts", F.posexplode("key_decisions").alias("pos", "decision")).select(
        stable_id("mem", F.col("session_id"), F.lit("decision"), F.col("pos")).alias("id"), "session_id", "project",
        F.lit("architecture").alias("type"), clip(F.col("decision"), 120).alias("title"), F.col("decision").alias("content"), *common,
    )
    ended = summary.select("session_id", at.alias("ended_at"))
    sources = observations.filter("compressed").select("session_id", F.col("id").alias("observation_id"))
    return Consolidated(summary, whole.unionByName(parts), end_sessions(sessions, ended), done.files, sources)


def memory_links(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Files or sources of each memory, through its session: a plain equi-join that AQE splits when a session is hot."""
    return memories.select(F.col("id").alias("memory_id"), "session_id").join(links, "session_id")
