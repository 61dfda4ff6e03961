"""Queries on bundles, snapshots, reviews, links, keys and latency."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from memspark.functions import events as ev
from memspark.functions.text import is_observation_id, is_session_id
from memspark.operators import duplicates as dup, quantiles, upserts as up, views as vw
from memspark.operators.capture import apply_compression
from memspark.operators.graph import links_from_audit
from memspark.operators.holds import replay_leases
from memspark.operators.mining import detect_patterns
from memspark.plans.capture_queries import _LEASES
from memspark.plans.registry import View, query
from memspark.plans.session_queries import _PATTERNS
from memspark.plans.views import NOW
from memspark.runtime import ensure_checkpoint_dir
from memspark.sources.bundles import create_snapshot, import_bundle, read_snapshot
from memspark.sources.enrichment import set_enrichment

_P = (500, 950, 990)
_UNITS = "CAST(ceil(round(seconds / 0.000001, 3)) AS BIGINT)"
_STEP = "CAST(pow(2.0, greatest(length(bin({0})) - 8, 0)) AS BIGINT)"


def _exact(share: int) -> str:
    """The exact quantile's bucket."""
    exact = f"max(CASE WHEN rn = greatest((n * {share} + 999) // 1000, 1) THEN u END)"
    step = _STEP.format(exact)
    return f"(({exact} // {step} + 1) * {step} - 1) * 0.000001 AS p{share}"


@query(
    "latency_percentiles", ["query_log"],
    f"""WITH u AS (SELECT mode, time_bucket(INTERVAL '1' HOUR, ts) AS window_start, {_UNITS} AS u FROM query_log WHERE seconds >= 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY mode, window_start ORDER BY u) AS rn, count(*) OVER (PARTITION BY mode, window_start) AS n FROM u)
        SELECT mode, window_start, max(n) AS n, {", ".join(_exact(p) for p in _P)} FROM r GROUP BY mode, window_start""",
)
def latency_percentiles(v: View) -> DataFrame:
    """The SQL sorts the values and takes the exact quantile's bucket."""
    return quantiles.percentiles(quantiles.sketch(v("query_log"), "seconds", ["mode"], width="1 hour"), _P)


@query(
    "latency_percentiles_merged", ["query_log"],
    f"""WITH r AS (SELECT mode, {_UNITS} AS u, row_number() OVER (PARTITION BY mode ORDER BY {_UNITS}) AS rn, count(*) OVER (PARTITION BY mode) AS n FROM query_log WHERE seconds >= 0)
        SELECT mode, max(n) AS n, {", ".join(_exact(p) for p in _P)} FROM r GROUP BY mode""",
)
def latency_percentiles_merged(v: View) -> DataFrame:
    """Sketches of hours added up."""
    return quantiles.percentiles(quantiles.over_windows(quantiles.sketch(v("query_log"), "seconds", ["mode"], width="1 hour")), _P)


@query(
    "bundle_import", ["sessions", "memories", "messages"],
    """WITH s AS (SELECT id, status FROM sessions WHERE status <> 'active'),
            m AS (SELECT id, tier FROM memories WHERE tier <> 'working')
       SELECT 'sessions' AS "table", id, status AS value FROM s
       UNION ALL SELECT DISTINCT 'sessions', session_id, 'completed' FROM messages WHERE session_id NOT IN (SELECT id FROM s)
       UNION ALL SELECT 'memories', id, tier FROM m
       UNION ALL SELECT 'memories', id, 'semantic' FROM memories WHERE tier = 'working'""",
)
def bundle_import(v: View) -> DataFrame:
    """A bundle of sessions without status and of memories without tier, most of them known."""
    local = {"sessions": v("sessions").filter("status <> 'active'"), "memories": v("memories").filter("tier <> 'working'")}
    bundle = {
        "sessions": v("messages").select(F.col("session_id").alias("id"), "project", F.lit("").alias("status")),
        "memories": v("memories").withColumn("tier", F.lit("")),
    }
    done = import_bundle(local, bundle)
    rows = done["sessions"].select(F.lit("sessions").alias("table"), "id", F.col("status").alias("value"))
    return rows.unionByName(done["memories"].select(F.lit("memories").alias("table"), "id", F.col("tier").alias("value")))


@query(
    "snapshot_read", ["sessions", "observations"],
    """SELECT 'sessions' AS "table", id FROM sessions WHERE project = 'src3' UNION ALL SELECT 'observations', id FROM observations WHERE project = 'src3' AND compressed""",
)
def snapshot_read(v: View) -> DataFrame:
    """One of two snapshots, written and read back."""
    tables = {"sessions": v("sessions"), "observations": v("observations")}
    spark = tables["sessions"].sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/memspark-snapshots-{uuid.uuid4().hex}"
    create_snapshot(tables, path, "s1", "src3")
    create_snapshot(tables, path, "s2", "src4")
    parts = [read_snapshot(spark, path, name, "s1").select(F.lit(name).alias("table"), "id") for name in tables]
    return parts[0].unionByName(parts[1])


@query(
    "enrichment_set", ["g_entities"],
    """SELECT id, CASE WHEN confidence >= 0.6 THEN 'about ' || name ELSE 'old' END AS enriched, CASE WHEN confidence >= 0.8 THEN confidence ELSE 1.0 END AS latitude,
              CAST(NULL AS DOUBLE) AS longitude FROM g_entities""",
)
def enrichment_set(v: View) -> DataFrame:
    entities = v("g_entities").withColumns({"enriched": F.lit("old"), "latitude": F.lit(1.0)})
    found = v("g_entities").filter("confidence >= 0.6").select(
        "id", F.concat(F.lit("about "), "name").alias("enriched"), F.when(F.col("confidence") >= 0.8, F.col("confidence")).alias("latitude"), F.lit(None).cast("double").alias("longitude")
    )
    return set_enrichment(entities, found).select("id", "enriched", "latitude", "longitude")


@query(
    "entity_subtype", [],
    """WITH n AS (SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '()' WHEN 2 THEN '.GO' ELSE '' END AS name, CASE WHEN p_size % 7 = 0 THEN 'PERSON' ELSE 'OBJECT' END AS type FROM part)
       SELECT id, CASE WHEN type = 'OBJECT' THEN CASE WHEN name LIKE '%.py' OR name LIKE '%.GO' THEN 'FILE' WHEN name LIKE '%()' THEN 'FUNCTION' END END AS subtype FROM n""",
)
def entity_subtype(v: View) -> DataFrame:
    end = F.expr("CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '()' WHEN 2 THEN '.GO' ELSE '' END")
    kind = F.when(F.col("p_size") % 7 == 0, "PERSON").otherwise("OBJECT")
    return v("part").select(F.col("p_partkey").alias("id"), ev.classify_subtype(F.concat("p_name", end), kind).alias("subtype"))


@query(
    "id_valid", [],
    """WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'obs-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 1 THEN 'sess-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') WHEN 2 THEN 'obs-' || CAST(doc_id % 1000 AS VARCHAR) ELSE source || '-' || lang END AS id FROM documents)
       SELECT doc_id, doc_id % 4 = 0 AS observation, doc_id % 4 = 1 AS session FROM i""",
)
def id_valid(v: View) -> DataFrame:
    """Ids under four characters after their prefix are not valid."""
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    made = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("obs-"), number)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("sess-"), number))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("obs-"), (F.col("doc_id") % 1000).cast("string"))).otherwise(F.concat("source", F.lit("-"), "lang"))
    )
    return v("documents").select("doc_id", is_observation_id(made).alias("observation"), is_session_id(made).alias("session"))


@query("audit_links", ["g_links"], "SELECT observation_id, entity_id FROM g_links")
def audit_links(v: View) -> DataFrame:
    """Links as the audit log keeps them, among other entries."""
    payload = F.to_json(F.struct("observation_id"))
    rows = v("g_links").select(F.lit("link").alias("action"), F.lit("entity").alias("target_type"), F.col("entity_id").alias("target_id"), payload.alias("payload"))
    other = rows.withColumn("action", F.lit("merge")).unionByName(rows.withColumn("target_type", F.lit("memory"))).unionByName(rows.withColumn("payload", F.lit("{}")))
    return links_from_audit(rows.unionByName(other))


@query(
    "same_as_upsert", ["same_as"],
    """SELECT source_id, target_id, greatest(confidence, 0.5) AS confidence, 'fuzzy' AS match_type, status, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM same_as
       UNION ALL SELECT target_id, source_id, 0.5, 'fuzzy', 'pending', TIMESTAMP '2024-01-02 00:00:00' FROM same_as""",
)
def same_as_upsert(v: View) -> DataFrame:
    """All pairs found again with another confidence, and turned round as new ones."""
    old = v("same_as").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    again = old.select("source_id", "target_id", F.lit(0.5).alias("confidence"), F.lit("fuzzy").alias("match_type"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("created_at"))
    turned = again.withColumnsRenamed({"source_id": "t", "target_id": "s"}).withColumnsRenamed({"t": "target_id", "s": "source_id"})
    return dup.upsert_same_as(old, again.unionByName(turned)).select("source_id", "target_id", "confidence", "match_type", "status", "created_at")


@query(
    "duplicates_review", ["same_as"],
    """SELECT source_id, target_id, CASE WHEN confidence >= 0.8 THEN 'confirmed' WHEN confidence < 0.4 THEN 'rejected' ELSE status END AS status FROM same_as""",
)
def duplicates_review(v: View) -> DataFrame:
    reviews = v("same_as").filter("confidence >= 0.8 OR confidence < 0.4").select("source_id", "target_id", (F.col("confidence") >= 0.8).alias("confirm"))
    return dup.review_duplicates(v("same_as"), reviews).select("source_id", "target_id", "status")


@query(
    "compression_apply", ["raw_observations"],
    """SELECT id, CASE WHEN id LIKE '%0' THEN 'before' ELSE coalesce(nullif(tool_name, ''), hook_type) END AS title, id NOT LIKE '%0' AS compressed FROM raw_observations""",
)
def compression_apply(v: View) -> DataFrame:
    """Compressed rows meet their observations; those without one stay as they are."""
    raw = v("raw_observations")
    made = ev.compress(raw.filter("id NOT LIKE '%0'"))
    return apply_compression(raw.withColumn("title", F.lit("before")), made).select("id", "title", "compressed")


@query(
    "keys_delete", ["preferences", "messages"],
    """SELECT 'preferences' AS "table", CAST(id AS VARCHAR) AS id FROM preferences WHERE id NOT IN (SELECT superseded_by FROM preferences WHERE superseded_by IS NOT NULL)
       UNION ALL SELECT 'messages', id FROM messages WHERE session_id NOT IN (SELECT session_id FROM messages WHERE role = 'system')""",
)
def keys_delete(v: View) -> DataFrame:
    """Preferences by id, and whole sessions of messages."""
    prefs = up.delete_keys(v("preferences"), v("preferences").filter("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id")), ["id"])
    rest = up.delete_keys(v("messages"), v("messages").filter("role = 'system'"), ["session_id"])
    return prefs.select(F.lit("preferences").alias("table"), F.col("id").cast("string").alias("id")).unionByName(rest.select(F.lit("messages").alias("table"), "id"))


@query("facts_confidence", ["preferences"], "SELECT id, CASE WHEN confidence <= 0 OR id % 3 = 0 THEN 1.0 ELSE confidence END AS confidence FROM preferences")
def facts_confidence(v: View) -> DataFrame:
    rows = v("preferences").withColumn("confidence", F.when(F.col("id") % 3 != 0, F.col("confidence")))
    return up.with_default_confidence(rows).select("id", "confidence")


@query(
    "patterns_list", ["observations"],
    f"WITH {_PATTERNS.format(recent=2**62)} SELECT project, pattern, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, pattern, project) AS place FROM found) x WHERE place <= 20",
)
def patterns_list(v: View) -> DataFrame:
    return vw.list_patterns(detect_patterns(v("observations"), now=NOW).select("project", "pattern", "n"))


_RELEASES = f"""{_LEASES.split("walk(", 1)[0].replace("FROM lease_log", "FROM lease_ops")}
    walk(action_id, rn, event_id, ts, op, holder, expires, granted) AS (
        SELECT action_id, rn, event_id, ts, op, CASE WHEN op = 'acquire' THEN holder_id END, CASE WHEN op = 'acquire' THEN ts + INTERVAL '6' HOUR END, op = 'acquire' FROM ordered WHERE rn = 1
        UNION ALL
        SELECT x.action_id, x.rn, x.event_id, x.ts, x.op,
               CASE WHEN x.op = 'release' THEN CASE WHEN w.holder = x.holder_id OR x.holder_id = '' THEN NULL ELSE w.holder END
                    WHEN w.holder IS NOT NULL AND x.ts < w.expires AND w.holder <> x.holder_id THEN w.holder ELSE x.holder_id END,
               CASE WHEN x.op = 'release' THEN w.expires
                    WHEN w.holder IS NOT NULL AND x.ts < w.expires AND w.holder <> x.holder_id THEN w.expires ELSE x.ts + INTERVAL '6' HOUR END,
               x.op = 'acquire' AND NOT (w.holder IS NOT NULL AND x.ts < w.expires AND w.holder <> x.holder_id)
        FROM walk w JOIN ordered x ON x.action_id = w.action_id AND x.rn = w.rn + 1)"""


@query(
    "lease_release", ["lease_log"],
    _RELEASES.replace("WITH RECURSIVE ordered", """WITH RECURSIVE lease_ops AS (SELECT event_id, action_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE holder_id END AS holder_id, ts,
        CASE WHEN event_id % 5 = 0 OR event_id % 4 = 1 THEN 'release' ELSE 'acquire' END AS op FROM lease_log), ordered""")
    + " SELECT event_id, action_id, granted FROM walk WHERE op = 'acquire'",
)
def lease_release(v: View) -> DataFrame:
    """Some entries give their lease back; those without a holder end anyone's."""
    op = F.when((F.col("event_id") % 5 == 0) | (F.col("event_id") % 4 == 1), "release").otherwise("acquire")
    log = v("lease_log").withColumns({"op": op, "holder_id": F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("holder_id"))})
    return replay_leases(log, 6 * 3600)[0].select("event_id", "action_id", "granted")
