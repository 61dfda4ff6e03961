"""Queries on session summaries, consolidation, lifecycle and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memspark.operators import lifecycle as life, mining
from memspark.operators.index import build_keyword_index
from memspark.operators.holds import dedup_window
from memspark.operators.sessions import DECISION, LEAD_SENTENCE, consolidate, memory_links, summarize_sessions
from memspark.functions.privacy import redact
from memspark.plans import oracle_text as o
from memspark.plans.registry import View, query
from memspark.plans.views import MEMORY_NOW, NOW

# The other engine has no Unicode flag.
_DECISION = DECISION.replace("(?iU)", "(?i)")
_LEAD = LEAD_SENTENCE
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

_SUMMARY = f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS rn FROM observations WHERE compressed),
    con AS (SELECT session_id, created_at, id, {_STRIP.format('lower(concepts[i])')} AS concept, i FROM o, (SELECT unnest(range(1, 4)) AS i) k),
    con_n AS (SELECT session_id, concept, count(*) AS n, min(struct_pack(a := created_at, b := id, c := i)) AS first FROM con WHERE concept <> '' GROUP BY session_id, concept),
    con_r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS r FROM con_n),
    concepts AS (SELECT session_id, string_agg(concept, ',' ORDER BY r) AS concepts, min(concept) FILTER (WHERE r = 1) AS lead FROM con_r WHERE r <= 10 GROUP BY session_id),
    quo AS (SELECT session_id, rn, {_STRIP.format('narrative')} AS n FROM o WHERE rn <= 20),
    quotes AS (SELECT session_id, string_agg({_STRIP.format(f"regexp_extract(n, {o.lit(_LEAD)}, 1)")}, ' • ' ORDER BY rn) AS narrative FROM quo WHERE regexp_matches(n, {o.lit(_LEAD)}) GROUP BY session_id),
    texts AS (SELECT session_id, created_at, id, 0 AS src, facts[1] AS t FROM o UNION ALL SELECT session_id, created_at, id, 1, narrative FROM o),
    hits AS (SELECT session_id, created_at, id, src, trim(unnest(regexp_extract_all(t, {o.lit(_DECISION)})), ' .,;:') AS d, generate_subscripts(regexp_extract_all(t, {o.lit(_DECISION)}), 1) AS p FROM texts),
    dec1 AS (SELECT *, row_number() OVER (PARTITION BY session_id, lower(d) ORDER BY created_at, id, src, p) AS k FROM hits),
    dec2 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id, src, p) AS r FROM dec1 WHERE k = 1),
    decisions AS (SELECT session_id, string_agg(d, '|' ORDER BY r) AS key_decisions FROM dec2 WHERE r <= 10 GROUP BY session_id),
    summary AS (
        SELECT b.session_id, b.project, 'Session on ' || coalesce(c.lead, b.title) AS title,
               CASE WHEN length(coalesce(q.narrative, '')) > 2000 THEN left(q.narrative, 1999) || '…' WHEN coalesce(q.narrative, '') = '' THEN '(no narratives)' ELSE q.narrative END AS narrative,
               coalesce(d.key_decisions, '') AS key_decisions, coalesce(c.concepts, '') AS concepts, b.n AS observations
        FROM (SELECT session_id, min(project) FILTER (WHERE rn = 1) AS project, min(title) FILTER (WHERE rn = 1) AS title, count(*) AS n FROM o GROUP BY session_id) b
        LEFT JOIN concepts c USING (session_id) LEFT JOIN quotes q USING (session_id) LEFT JOIN decisions d USING (session_id))"""


@query("session_summary", ["observations"], f"WITH {_SUMMARY} SELECT * FROM summary")
def session_summary(v: View) -> DataFrame:
    s = summarize_sessions(v("observations")).summaries
    return s.withColumns({"key_decisions": F.array_join("key_decisions", "|"), "concepts": F.array_join("concepts", ",")})


@query("session_summary_light", ["observations"], f"WITH {_SUMMARY} SELECT session_id, project, title, concepts, observations FROM summary")
def session_summary_light(v: View) -> DataFrame:
    return summarize_sessions(v("observations"), style="light").summaries.withColumn("concepts", F.array_join("concepts", ","))


@query(
    "session_sentences", ["observations"],
    r"""WITH s AS (SELECT session_id, id, narrative, length(regexp_extract(narrative, '^[^.!?]*')) AS n FROM observations WHERE compressed AND narrative <> '')
        SELECT session_id, id, CASE WHEN n < length(narrative) AND n <= 200 THEN left(narrative, n) ELSE left(narrative, 200) END AS sentence FROM s""",
)
def session_sentences(v: View) -> DataFrame:
    return summarize_sessions(v("observations"), style="light").sentences.select("session_id", "id", "sentence")


@query(
    "session_files", ["observations"],
    """WITH f AS (SELECT session_id, created_at, id, unnest(files) AS file FROM observations WHERE compressed)
       SELECT session_id, file, min(created_at) AS first_at, arg_min(id, created_at) AS first_id FROM f GROUP BY session_id, file""",
)
def session_files(v: View) -> DataFrame:
    return summarize_sessions(v("observations")).files.drop("first_pos")


@query(
    "consolidate_memories", ["observations"],
    f"""WITH {_SUMMARY} SELECT session_id, project, 'workflow' AS type, 'semantic' AS tier, title, narrative AS content, 1.0 AS strength FROM summary
        UNION ALL SELECT session_id, s.project, 'architecture', 'semantic', CASE WHEN length(d) > 120 THEN left(d, 119) || '…' ELSE d END, d, 1.0
        FROM dec2 JOIN summary s USING (session_id) WHERE r <= 10""",
)
def consolidate_memories(v: View) -> DataFrame:
    done = consolidate(v("observations"), v("sessions"), NOW)
    return done.memories.select("session_id", "project", "type", "tier", "title", "content", "strength")


@query(
    "consolidate_sessions", ["observations", "sessions"],
    f"""WITH done AS (SELECT DISTINCT session_id FROM observations WHERE compressed)
        SELECT id, CASE WHEN session_id IS NOT NULL THEN 'completed' ELSE status END AS status, CASE WHEN session_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE ended_at END AS ended_at
        FROM sessions LEFT JOIN done ON session_id = id""",
)
def consolidate_sessions(v: View) -> DataFrame:
    return consolidate(v("observations"), v("sessions"), NOW).sessions.select("id", "status", "ended_at")


@query(
    "memory_source_counts", ["observations"],
    f"""WITH {_SUMMARY}, mem AS (SELECT session_id, title FROM summary UNION ALL SELECT session_id, CASE WHEN length(d) > 120 THEN left(d, 119) || '…' ELSE d END FROM dec2 WHERE r <= 10)
        SELECT m.session_id, m.title, s.observations AS sources FROM mem m JOIN summary s USING (session_id)""",
)
def memory_sources(v: View) -> DataFrame:
    done = consolidate(v("observations"), v("sessions"), NOW)
    links = memory_links(done.memories, done.sources).groupBy("memory_id").agg(F.count(F.lit(1)).alias("sources"))
    return done.memories.select(F.col("id").alias("memory_id"), "session_id", "title").join(links, "memory_id").drop("memory_id")


_DECAY = f"""
    d AS (SELECT *, tier IN ('semantic', 'procedural') AND is_latest AS due, coalesce(last_retrieved_at > created_at, false) AS recalled FROM memories),
    aged AS (SELECT *, CASE WHEN due THEN (CASE WHEN recalled THEN least(1.0, strength + 0.05) ELSE strength END)
                 * pow(0.95, greatest(0.0, epoch(TIMESTAMP '{MEMORY_NOW}' - CASE WHEN recalled THEN last_retrieved_at ELSE created_at END) / 86400.0)) ELSE strength END AS s FROM d)"""


@query("decay", ["memories"], f"WITH {_DECAY} SELECT id, tier, round(s, 9) AS strength FROM aged WHERE NOT (due AND s < 0.1)")
def decay_kept(v: View) -> DataFrame:
    return life.decay(v("memories"), MEMORY_NOW)[0].select("id", "tier", F.round("strength", life.STRENGTH_DIGITS).alias("strength"))


@query("decay_evicted", ["memories"], f"WITH {_DECAY} SELECT id, round(s, 9) AS strength FROM aged WHERE due AND s < 0.1")
def decay_evicted(v: View) -> DataFrame:
    return life.decay(v("memories"), MEMORY_NOW)[1].select("id", F.round("strength", life.STRENGTH_DIGITS).alias("strength"))


@query("review_band", ["memories"], "SELECT id, strength FROM memories WHERE strength BETWEEN 0.1 AND 0.3")
def review_band(v: View) -> DataFrame:
    return life.review_band(v("memories")).select("id", "strength")


_EVICT = f"""
    e AS (SELECT id, CASE WHEN NOT compressed AND created_at < TIMESTAMP '{NOW}' - INTERVAL '24' HOUR THEN 'working'
          WHEN compressed AND created_at < TIMESTAMP '{NOW}' - INTERVAL '7' DAY AND session_id IN (SELECT id FROM sessions WHERE status <> 'completed') THEN 'episodic' END AS tier FROM observations)"""


@query("ttl_evict", ["observations", "sessions"], f"WITH {_EVICT} SELECT id, tier FROM e WHERE tier IS NOT NULL")
def ttl_evict(v: View) -> DataFrame:
    return life.evict_observations(v("observations"), v("sessions"), NOW)[1].select("id", F.col("evicted_tier").alias("tier"))


@query("ttl_kept", ["observations", "sessions"], f"WITH {_EVICT} SELECT id FROM e WHERE tier IS NULL")
def ttl_kept(v: View) -> DataFrame:
    return life.evict_observations(v("observations"), v("sessions"), NOW)[0].select("id")


@query("lesson_decay", ["lessons"], "SELECT id, round(strength * 0.95, 9) AS strength FROM lessons WHERE strength * 0.95 >= 0.1")
def lesson_decay(v: View) -> DataFrame:
    return life.decay_lessons(v("lessons")).select("id", F.round("strength", 9).alias("strength"))


@query(
    "decay_report", ["memories", "observations", "sessions"],
    f"""WITH {_DECAY}, {_EVICT} SELECT count(*) FILTER (WHERE due) AS evaluated, count(*) FILTER (WHERE due AND s < 0.1) AS evicted, count(*) FILTER (WHERE due AND s >= 0.1) AS updated_strength,
        (SELECT count(*) FROM e WHERE tier = 'working') AS working_evicted, (SELECT count(*) FROM e WHERE tier = 'episodic') AS episodic_evicted FROM aged""".replace(
        f"'{MEMORY_NOW}'", f"'{NOW}'"
    ),
)
def decay_report(v: View) -> DataFrame:
    return life.decay_report(v("memories"), v("observations"), v("sessions"), NOW)


_STATS = f"""stats AS (SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM observations) AS observations,
    (SELECT count(*) FROM observations WHERE compressed) AS compressed, (SELECT count(*) FROM observations WHERE NOT compressed) AS uncompressed,
    (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM documents) AS indexed_docs, (SELECT count(*) FROM embeddings) AS vector_docs,
    (SELECT count(*) FROM sessions WHERE status = 'active' AND started_at < TIMESTAMP '{NOW}' - INTERVAL '48' HOUR) AS stuck_sessions,
    (SELECT count(*) FROM observations o WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.id = o.session_id)) AS orphaned_observations)"""


def _diagnosis(v: View, indexed: bool = True):
    docs = build_keyword_index(v("documents"), project_col=None).docs
    docs = docs if indexed else docs.filter(F.lit(False))
    return life.diagnose(v("sessions"), v("observations"), v("memories"), docs, v("vectors"), NOW)


@query("diagnose", ["sessions", "observations", "memories"], f"WITH {_STATS} SELECT *, true AS healthy FROM stats")
def diagnose(v: View) -> DataFrame:
    return _diagnosis(v)[0]


@query(
    "diagnose_issues", ["sessions", "observations", "memories"],
    f"""WITH {_STATS} SELECT 'bm25_index' AS component, 'warning' AS severity, true AS fixable, compressed AS n FROM stats WHERE compressed > 0
        UNION ALL SELECT 'sessions', 'warning', true, stuck_sessions FROM stats WHERE stuck_sessions > 0
        UNION ALL SELECT 'observations', 'warning', true, orphaned_observations FROM stats WHERE orphaned_observations > 0""",
)
def diagnose_issues(v: View) -> DataFrame:
    return _diagnosis(v, indexed=False)[1].select("component", "severity", "fixable", "n")


def _healed(v: View):
    marks = v("events").select("event_id", F.col("ts").cast("timestamp").alias("seen_at"))
    return life.heal(v("sessions"), v("observations"), marks, NOW)


_STUCK = f"status = 'active' AND started_at < TIMESTAMP '{NOW}' - INTERVAL '48' HOUR"


@query(
    "heal_report", ["sessions", "observations", "hooks"],
    f"""SELECT (SELECT count(*) FROM sessions WHERE {_STUCK}) AS sessions_abandoned,
        (SELECT count(*) FROM observations o WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.id = o.session_id)) AS observations_removed,
        (SELECT count(*) FROM hooks WHERE ts < TIMESTAMP '{NOW}' - INTERVAL '10' MINUTE) AS dedup_marks_pruned""",
)
def heal_report(v: View) -> DataFrame:
    return _healed(v)[3]


@query("heal_sessions", ["sessions"], f"SELECT id, CASE WHEN {_STUCK} THEN 'abandoned' ELSE status END AS status, CASE WHEN {_STUCK} THEN TIMESTAMP '{NOW}' ELSE ended_at END AS ended_at FROM sessions")
def heal_sessions(v: View) -> DataFrame:
    return _healed(v)[0].select("id", "status", "ended_at")


@query("heal_observations", ["sessions", "observations"], "SELECT id FROM observations WHERE session_id IN (SELECT id FROM sessions)")
def heal_observations(v: View) -> DataFrame:
    return _healed(v)[1].select("id")


def _top(column: str, out: str) -> str:
    return f"""WITH c AS (SELECT project, {out}, count(*) AS n FROM (SELECT project, unnest({column}) AS {out} FROM observations WHERE compressed) u WHERE {out} <> '' GROUP BY project, {out})
        SELECT project, {out}, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, {out}) AS rank FROM c) r WHERE rank <= 20"""


@query("project_profile_concepts", ["observations"], _top("concepts", "concept"))
def profile_concepts(v: View) -> DataFrame:
    return mining.profile_concepts(v("observations"))


@query("project_profile_files", ["observations"], _top("files", "file"))
def profile_files(v: View) -> DataFrame:
    return mining.profile_files(v("observations"))


@query("project_profile_types", ["memories"], "SELECT project, coalesce(type, 'unknown') AS type, count(*) AS n FROM memories GROUP BY ALL")
def profile_types(v: View) -> DataFrame:
    return mining.profile_types(v("memories"))


@query(
    "project_profile_totals", ["observations", "memories"],
    """SELECT project, CAST(sum(o) AS BIGINT) AS total_observations, CAST(sum(m) AS BIGINT) AS total_memories FROM (
       SELECT project, 1 AS o, 0 AS m FROM observations WHERE compressed UNION ALL SELECT project, 0, 1 FROM memories) x GROUP BY project""",
)
def profile_totals(v: View) -> DataFrame:
    return mining.profile_totals(v("observations"), v("memories"))


_FNV = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
_PATTERNS = f"""
    p_obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS rn FROM observations WHERE compressed) r WHERE rn <= {{recent}}),
    pairs AS (SELECT project, id, title, created_at, 10 * i + j AS pos, least(concepts[i], concepts[j]) || ' + ' || greatest(concepts[i], concepts[j]) AS pattern
              FROM p_obs, (SELECT unnest(range(1, 4)) AS i) a, (SELECT unnest(range(1, 4)) AS j) b WHERE i < j),
    links AS (SELECT project, id, title, created_at, 100 + 10 * i + j AS pos, regexp_extract(files[i], '([^/\\\\]*)$', 1) || ' → ' || concepts[j] AS pattern
              FROM p_obs, (SELECT unnest(range(1, 3)) AS i) a, (SELECT unnest(range(1, 4)) AS j) b WHERE i <= len(files)),
    mentions AS (SELECT * FROM pairs UNION ALL SELECT * FROM links),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, pattern) AS rank FROM (SELECT project, pattern, count(*) AS n FROM mentions GROUP BY project, pattern HAVING count(*) >= 2) c) r WHERE rank <= 20),
    shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, pattern ORDER BY created_at DESC, id, pos) AS ex FROM mentions) s WHERE ex <= 3),
    examples AS (SELECT project, pattern, string_agg(id, ',' ORDER BY ex) AS examples FROM shown GROUP BY project, pattern),
    found AS (SELECT 'pat-' || lpad(lower(hex({_FNV.format("(project || ':' || pattern)")})), 8, '0') AS id, project, pattern, n, rank, examples FROM best JOIN examples USING (project, pattern))"""


@query("patterns_detect", ["observations"], f"WITH {_PATTERNS.format(recent=2**62)} SELECT id, project, pattern, n, rank, examples FROM found")
def patterns_detect(v: View) -> DataFrame:
    found = mining.detect_patterns(v("observations"), now=NOW)
    return found.select("id", "project", "pattern", "n", "rank", F.array_join("examples.obs_id", ",").alias("examples"))


@query(
    "pattern_upsert", ["observations"],
    f"""WITH {_PATTERNS.format(recent=2**62)}, old AS (SELECT id, project, pattern, n + rank % 3 - 1 AS n, examples FROM found WHERE rank > 5),
        new AS (SELECT * FROM found WHERE rank <= 15)
        SELECT coalesce(new.id, old.id) AS id, coalesce(new.project, old.project) AS project, greatest(old.n, new.n) AS n, coalesce(new.examples, old.examples) AS examples
        FROM old FULL JOIN new ON old.id = new.id""",
)
def pattern_upsert(v: View) -> DataFrame:
    found = mining.detect_patterns(v("observations"), now=NOW)
    old = found.filter("rank > 5").withColumn("n", F.col("n") + F.col("rank") % 3 - 1)
    merged = mining.upsert_patterns(old, found.filter("rank <= 15"))
    return merged.select("id", "project", "n", F.array_join("examples.obs_id", ",").alias("examples"))


@query(
    "skills_rollup", ["skill_events"],
    """SELECT project, skill_name, count(*) AS evidence_count, max(demonstrated_at) AS last_demonstrated,
       CASE WHEN count(*) >= 10 THEN 'expert' WHEN count(*) >= 3 THEN 'competent' ELSE 'novice' END AS level FROM skill_events GROUP BY project, skill_name""",
)
def skills_rollup(v: View) -> DataFrame:
    return mining.skills_rollup(v("skill_events"))


@query("ops_counters", ["hooks"], "SELECT project, hook_type, status, count(*) AS n FROM hooks GROUP BY ALL")
def ops_counters(v: View) -> DataFrame:
    return mining.observation_counters(v("hooks"))


@query(
    "dedup_counters", ["hooks"],
    """WITH RECURSIVE ordered AS (SELECT session_id AS k, project, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM hooks),
       walk(k, project, rn, anchor, dup) AS (SELECT k, project, rn, ts, false FROM ordered WHERE rn = 1 UNION ALL
         SELECT x.k, x.project, x.rn, CASE WHEN x.ts < w.anchor + INTERVAL '1' HOUR THEN w.anchor ELSE x.ts END, x.ts < w.anchor + INTERVAL '1' HOUR
         FROM walk w JOIN ordered x ON x.k = w.k AND x.rn = w.rn + 1)
       SELECT project, count(*) AS n FROM walk WHERE dup GROUP BY project""",
)
def dedup_counters(v: View) -> DataFrame:
    flagged = dedup_window(v("hooks").select("event_id", "session_id", "project", "ts"), ["session_id"], "ts", "event_id", 3600)
    return mining.dedup_counters(flagged)


@query(
    "redaction_counters", [],
    f"WITH {o.redaction('documents', 'doc_id', 'text')}, n AS (SELECT unnest(string_split({o.hit_names()}, ',')) AS pattern FROM redacted) SELECT pattern, count(*) AS n FROM n WHERE pattern <> '' GROUP BY pattern",
)
def redaction_counters(v: View) -> DataFrame:
    return mining.redaction_counters(redact(v("documents").select("doc_id", "text"), "text"))


@query("eviction_counters", ["observations", "sessions"], f"WITH {_EVICT} SELECT tier, count(*) AS n FROM e WHERE tier IS NOT NULL GROUP BY tier")
def eviction_counters(v: View) -> DataFrame:
    return mining.eviction_counters(life.evict_observations(v("observations"), v("sessions"), NOW)[1])


_BOUNDS = ", ".join(f"({0.001 * 2**i!r})" for i in range(mining.LATENCY_BUCKETS))


@query(
    "query_latency", ["query_log"],
    f"""WITH b(le) AS (VALUES {_BOUNDS}) SELECT mode, le, count(*) FILTER (WHERE seconds <= le) AS n FROM query_log, b GROUP BY mode, le
        UNION ALL SELECT mode, CAST('Infinity' AS DOUBLE), count(*) FROM query_log GROUP BY mode""",
)
def query_latency(v: View) -> DataFrame:
    return mining.latency_histogram(v("query_log")).select("mode", "le", "n")


@query(
    "windowed_counters", ["hooks"],
    """SELECT time_bucket(INTERVAL '1' HOUR, ts) AS window_start, project, hook_type, count(*) AS n FROM hooks GROUP BY ALL""",
)
def windowed_counters(v: View) -> DataFrame:
    from memspark.streaming.counters import windowed_counts

    return windowed_counts(v("hooks"), "1 hour")
