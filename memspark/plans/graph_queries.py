"""Queries that write graph tables and find duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memspark.operators import duplicates as dup
from memspark.operators.graph import insert_edges, merge_edges, upsert_entities
from memspark.plans.registry import View, query
from memspark.plans.views import NOW
from memspark.sources.enrichment import enrich


@query(
    "entity_upsert", ["g_mentions"],
    """SELECT project, name, type, max(confidence) AS confidence, coalesce(arg_max(subtype, seen_at) FILTER (WHERE subtype <> ''), '') AS subtype
       FROM g_mentions GROUP BY project, name, type""",
)
def entity_upsert(v: View) -> DataFrame:
    return upsert_entities(v("g_mentions")).drop("updated_at")


@query(
    "edge_merge", ["g_edges"],
    """SELECT source_id, target_id, type, max(confidence) AS confidence, min(f) AS source_observation_id FROM (
       SELECT *, first_value(source_observation_id) OVER (PARTITION BY source_id, target_id, type ORDER BY seen_at, source_observation_id) AS f FROM g_edges) e
       GROUP BY source_id, target_id, type""",
)
def edge_merge(v: View) -> DataFrame:
    return merge_edges(v("g_edges"))


@query(
    "edge_insert", ["g_edges"],
    """SELECT source_id, target_id, type, max(confidence) AS confidence FROM g_edges WHERE confidence < 0.5 OR NOT ends_with(source_id, '7')
       GROUP BY source_id, target_id, type""",
)
def edge_insert(v: View) -> DataFrame:
    """The surer edges come in; those asked for without a type are rejected."""
    typed = F.when(F.col("source_id").endswith("7"), "").otherwise(F.col("type"))
    kept, _ = insert_edges(v("g_edges").filter("confidence < 0.5"), v("g_edges").filter("confidence >= 0.5").withColumn("type", typed))
    return kept.drop("source_observation_id")


@query(
    "entity_duplicates", ["dup_entities"],
    """WITH named AS (SELECT id, project, type, lower(name) AS key FROM dup_entities),
       reps AS (SELECT project, type, key, min(id) AS rep FROM named GROUP BY project, type, key)
       SELECT rep AS source_id, id AS target_id, 0.98 AS confidence, 'exact' AS match_type FROM named JOIN reps USING (project, type, key) WHERE id <> rep
       UNION ALL
       SELECT least(a.rep, b.rep), greatest(a.rep, b.rep), round(1 - 0.1 * levenshtein(a.key, b.key), 2), 'fuzzy'
       FROM reps a JOIN reps b ON a.project = b.project AND a.type = b.type AND a.key < b.key
       WHERE length(a.key) >= 3 AND length(b.key) >= 3 AND abs(length(a.key) - length(b.key)) <= 2 AND levenshtein(a.key, b.key) <= 2""",
)
def entity_duplicates(v: View) -> DataFrame:
    return dup.flag_duplicates(v("dup_entities"))


@query(
    "pending_duplicates", ["same_as", "g_entities"],
    """SELECT s.source_id, s.target_id, s.confidence, s.match_type FROM same_as s JOIN g_entities e ON e.id = s.source_id
       WHERE s.status = 'pending' AND s.confidence >= 0.7 ORDER BY s.confidence DESC, s.source_id, s.target_id LIMIT 100""",
)
def pending(v: View) -> DataFrame:
    return dup.pending_duplicates(v("same_as"), v("g_entities")).select("source_id", "target_id", "confidence", "match_type")


@query(
    "auto_merge", ["same_as", "g_entities"],
    """SELECT source_id, target_id, CASE WHEN status = 'pending' AND confidence >= 0.95 AND source_id IN (SELECT id FROM g_entities) THEN 'confirmed' ELSE status END AS status FROM same_as""",
)
def auto_merge(v: View) -> DataFrame:
    table, _ = dup.auto_merge(v("same_as"), v("g_entities"))
    return table.select("source_id", "target_id", "status")


@query(
    "auto_merge_report", ["same_as", "g_entities"],
    """SELECT count(*) AS found, CAST(0 AS BIGINT) AS merged, true AS dry_run FROM same_as WHERE status = 'pending' AND confidence >= 0.95 AND source_id IN (SELECT id FROM g_entities)""",
)
def auto_merge_report(v: View) -> DataFrame:
    return dup.auto_merge(v("same_as"), v("g_entities"), dry_run=True)[1]


@query(
    "canonical_ids", ["same_as"],
    """WITH RECURSIVE pairs AS (SELECT source_id AS a, target_id AS b FROM same_as WHERE status = 'confirmed' UNION SELECT target_id, source_id FROM same_as WHERE status = 'confirmed'),
       reach(a, b) AS (SELECT a, a FROM pairs UNION SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
       SELECT a AS id, min(b) AS canonical_id FROM reach GROUP BY a""",
)
def canonical(v: View) -> DataFrame:
    return dup.canonical_ids(v("same_as"))


@query(
    "similar_memories", ["memories", "new_memories"],
    """WITH cand AS (
         SELECT n.id AS new_id, n.title AS nt, n.content AS nc, m.id AS memory_id, m.title, m.content, m.strength,
                row_number() OVER (PARTITION BY n.id ORDER BY m.strength DESC, m.id) AS rn
         FROM new_memories n JOIN memories m ON m.project = n.project AND (contains(lower(m.title), lower(n.content)) OR contains(lower(m.content), lower(n.content)))),
       sets AS (SELECT *, list_distinct(string_split(lower(title), ' ')) AS wt, list_distinct(string_split(lower(nt), ' ')) AS wnt,
                list_distinct(string_split(lower(content), ' ')) AS wc, list_distinct(string_split(lower(nc), ' ')) AS wnc FROM cand WHERE rn <= 5)
       SELECT new_id, memory_id, title, strength FROM sets
       WHERE len(list_intersect(wt, wnt)) / len(list_distinct(list_concat(wt, wnt))) >= 0.6 OR len(list_intersect(wc, wnc)) / len(list_distinct(list_concat(wc, wnc))) >= 0.5""",
)
def similar(v: View) -> DataFrame:
    return dup.similar_memories(v("new_memories"), v("memories"))


_FRESH = f"""fresh AS (SELECT type, lower(name) AS key, arg_max(summary, fetched_at) AS summary, max(fetched_at) AS fetched_at FROM enrichment
    GROUP BY type, lower(name) HAVING max(fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY)"""


@query(
    "enrich_join", ["g_entities", "enrichment"],
    f"""WITH {_FRESH} SELECT e.id, f.summary, f.fetched_at FROM g_entities e LEFT JOIN fresh f ON f.type = e.type AND f.key = lower(e.name) AND NOT e.sensitive""",
)
def enrich_join(v: View) -> DataFrame:
    return enrich(v("g_entities"), v("enrichment"), NOW)[0].select("id", "summary", "fetched_at")


@query(
    "enrich_todo", ["g_entities", "enrichment"],
    f"""WITH {_FRESH} SELECT DISTINCT e.type, lower(e.name) AS key FROM g_entities e WHERE NOT e.sensitive AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.type = e.type AND f.key = lower(e.name))""",
)
def enrich_todo(v: View) -> DataFrame:
    return enrich(v("g_entities"), v("enrichment"), NOW)[1]
