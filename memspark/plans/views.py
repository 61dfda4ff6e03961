"""Agent-memory tables derived from the driver's tables.

One SQL text per view serves Spark and the oracle; ``{arr}`` is the array constructor of either. All views cover their
whole base tables, and their keys grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memspark.sources.tables import read_table

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

NOW = "2024-01-20 00:00:00"
MEMORY_NOW = "2001-08-31 00:00:00"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}-' || lpad(CAST({key} AS STRING), 12, '0')"


VIEWS = {
    "observations": f"""
        SELECT {_id('obs', 'doc_id')} AS id, {_id('sess', 'CAST(floor(doc_id / 8.0) AS BIGINT)')} AS session_id, source AS project,
               CASE doc_id % 5 WHEN 0 THEN 'user_prompt' WHEN 1 THEN 'pre_tool_use' WHEN 2 THEN 'post_tool_use'
                               WHEN 3 THEN 'post_tool_failure' ELSE 'notification' END AS hook_type,
               CASE doc_id % 6 WHEN 1 THEN 'read' WHEN 2 THEN 'Bash' WHEN 3 THEN 'grep' WHEN 4 THEN 'curl'
                               WHEN 5 THEN 'custom_tool' END AS tool_name,
               'note' AS type, (doc_id % 10) <> 0 AS compressed, lang || ' note from ' || source AS title, text AS narrative,
               CAST(NULL AS STRING) AS tool_output,
               {{arr}}(lang, 'topic-' || CAST(doc_id % 7 AS STRING), 'area-' || CAST(doc_id % 11 AS STRING)) AS concepts,
               CASE WHEN doc_id % 3 = 0
                    THEN {{arr}}('src/' || source || '/mod_' || CAST(doc_id % 13 AS STRING) || '.py', 'docs/' || lang || '.md')
                    ELSE {{arr}}('src/' || source || '/mod_' || CAST(doc_id % 13 AS STRING) || '.py') END AS files,
               {{arr}}('Decided to keep notes of ' || source || ' in ' || lang || '.') AS facts,
               TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '17' MINUTE AS created_at
        FROM documents""",
    "raw_observations": f"""
        SELECT {_id('obs', 'p_partkey')} AS id, {_id('sess', 'p_size')} AS session_id,
               CASE WHEN p_size % 2 = 0 THEN 'post_tool_use' ELSE 'user_prompt' END AS hook_type,
               CASE p_size % 4 WHEN 0 THEN 'Edit' WHEN 1 THEN 'pytest' WHEN 2 THEN 'deploy' END AS tool_name,
               '{{"path":"src/' || replace(p_brand, '#', '_') || '/' || replace(p_name, ' ', '_') || '.py"}}' AS tool_input,
               p_name || ' wrote ./out/' || p_type || '.json and "lib/util.go" for part ' || CAST(p_partkey AS STRING) || ' of ' || p_brand AS tool_output,
               CASE WHEN p_size % 3 = 0 THEN 'see docs/readme.md and src/main.rs' END AS user_prompt
        FROM part""",
    "sessions": f"""
        SELECT DISTINCT {_id('sess', 'conv_id')} AS id, 'src' || CAST(conv_id % 20 AS STRING) AS project, '/work' AS cwd,
               CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' ELSE 'abandoned' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '11' HOUR AS started_at,
               CAST(NULL AS TIMESTAMP) AS ended_at
        FROM conversations""",
    "memories": f"""
        SELECT {_id('mem', 'o_orderkey')} AS id, 'proj-' || CAST(o_custkey % 20 AS STRING) AS project,
               CASE o_orderkey % 6 WHEN 0 THEN 'architecture' WHEN 1 THEN 'pattern' WHEN 2 THEN 'preference' WHEN 3 THEN 'bug'
                                   WHEN 4 THEN 'workflow' ELSE 'fact' END AS type,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'working' WHEN '2' THEN 'episodic' WHEN '3' THEN 'procedural'
                                   ELSE 'semantic' END AS tier,
               'Order ' || CAST(o_orderkey AS STRING) AS title, o_orderpriority || ' status ' || o_orderstatus AS content,
               CAST(1 + o_orderkey % 100 AS DOUBLE) / 100 AS strength, (o_orderkey % 9) <> 0 AS is_latest,
               TIMESTAMP '2001-08-31 00:00:00' - (o_orderkey % 60) * INTERVAL '1' DAY AS created_at,
               CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-08-31 00:00:00' - (o_orderkey % 20) * INTERVAL '1' DAY END AS last_retrieved_at
        FROM orders""",
    "new_memories": f"""
        SELECT {_id('new', 'c_custkey')} AS id, 'proj-' || CAST(c_custkey % 20 AS STRING) AS project, 'Order ' || CAST(c_custkey AS STRING) AS title,
               CASE c_nationkey % 5 WHEN 0 THEN '1-URGENT status F' WHEN 1 THEN '2-HIGH status O' WHEN 2 THEN 'order 77'
                                    WHEN 3 THEN '5-LOW status P' ELSE lower(c_mktsegment) || ' plan' END AS content
        FROM customer""",
    "g_entities": """
        SELECT 'ent-p' || CAST(p_partkey AS STRING) AS id, 'demo' AS project, p_name || ' ' || CAST(p_partkey AS STRING) AS name,
               'OBJECT' AS type, p_type AS subtype, CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence, p_type = 'SMALL' AS sensitive
        FROM part
        UNION ALL
        SELECT 'ent-s' || CAST(s_suppkey AS STRING), 'demo', s_name, 'ORGANIZATION', '', CAST(40 + s_suppkey % 60 AS DOUBLE) / 100, false
        FROM supplier""",
    "dup_entities": """
        SELECT 'ent-p' || CAST(p_partkey AS STRING) AS id, 'demo' AS project, p_name || ' ' || CAST(p_partkey AS STRING) AS name, 'OBJECT' AS type FROM part
        UNION ALL
        SELECT 'ent-u' || CAST(p_partkey AS STRING), 'demo', upper(p_name) || ' ' || CAST(p_partkey AS STRING), 'OBJECT' FROM part WHERE p_type = 'SMALL'
        UNION ALL
        SELECT 'ent-s' || CAST(s_suppkey AS STRING), 'demo', s_name, 'ORGANIZATION' FROM supplier""",
    "same_as": """
        SELECT 'ent-p' || CAST(l_partkey AS STRING) AS source_id, 'ent-s' || CAST(l_suppkey AS STRING) AS target_id, max(l_quantity) / 50 AS confidence,
               CASE WHEN max(l_linenumber) > 3 THEN 'exact' ELSE 'fuzzy' END AS match_type,
               CASE min(l_returnflag) WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'rejected' ELSE 'pending' END AS status
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "g_edges": """
        SELECT 'edg-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, 'demo' AS project,
               'ent-p' || CAST(l_partkey AS STRING) AS source_id, 'ent-s' || CAST(l_suppkey AS STRING) AS target_id,
               'DEPENDS_ON' AS type, l_quantity / 50 AS confidence, 'obs-' || CAST(l_orderkey AS STRING) AS source_observation_id,
               CAST(l_shipdate AS TIMESTAMP) AS seen_at
        FROM lineitem""",
    "g_links": f"""
        SELECT {_id('obs', 'doc_id')} AS observation_id, 'ent-p' || CAST(doc_id AS STRING) AS entity_id FROM documents
        UNION ALL
        SELECT {_id('obs', 'doc_id')}, 'ent-s' || CAST(CAST(floor(doc_id / 10.0) AS BIGINT) AS STRING) FROM documents""",
    "g_mentions": """
        SELECT 'demo' AS project, p_name AS name, 'OBJECT' AS type, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS subtype,
               CAST(p_size AS DOUBLE) / 100 AS confidence, TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS seen_at
        FROM part
        UNION ALL
        SELECT 'demo', n_name, 'LOCATION', '', 0.5, TIMESTAMP '2024-01-01 00:00:00' FROM nation""",
    "vectors": f"""
        SELECT {_id('obs', 'vec_id')} AS doc_id, 'src' || CAST(vec_id % 20 AS STRING) AS project, embedding FROM embeddings""",
    "queries": "SELECT item_id AS query_id, '' AS project, text AS query FROM benchmark",
    "project_queries": "SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS STRING) AS project, text AS query FROM benchmark",
    "query_vectors": """
        SELECT item_id AS query_id, '' AS project, embedding FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "hooks": f"""
        SELECT event_id, {_id('sess', 'user_id')} AS session_id, 'proj-' || CAST(user_id % 5 AS STRING) AS project, '/work' AS cwd,
               CASE event_type WHEN 'purchase' THEN 'session_end' WHEN 'click' THEN 'pre_tool_use' WHEN 'error' THEN 'post_tool_failure'
                               WHEN 'signup' THEN 'session_start' ELSE 'user_prompt' END AS hook_type,
               event_type AS tool_name, props AS tool_input, value, CAST(ts AS TIMESTAMP) AS ts,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'accepted' END AS status,
               '{{"tool_name":"' || event_type || '","tool_input":' || props || ',"tool_output":"value ' || CAST(event_id AS STRING)
                  || ' token = tk' || md5(CAST(event_id AS STRING)) || '","user_prompt":"run ' || CAST(user_id AS STRING) || '"}}' AS data
        FROM events""",
    "page_payloads": """
        SELECT page_id AS id,
               CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN html || ' data:image/png;base64,' || md5(url)
                                ELSE 'data:image/png;base64,' || md5(url) || ' ok' END AS raw
        FROM pages""",
    "messages": f"""
        SELECT 'msg-' || lpad(CAST(conv_id AS STRING), 12, '0') || '-' || lpad(CAST(turn AS STRING), 4, '0') AS id, {_id('sess', 'conv_id')} AS session_id,
               {_id('conv', 'conv_id')} AS conversation_id, 'src' || CAST(conv_id % 20 AS STRING) AS project, role, text AS content,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '3' HOUR + turn * INTERVAL '1' MINUTE AS created_at
        FROM conversations""",
    "memory_facets": f"""
        SELECT {_id('mem', 'doc_id')} AS memory_id, 'quality' AS dimension, CAST(quality AS STRING) AS value FROM labels
        UNION ALL
        SELECT {_id('mem', 'doc_id')}, 'toxic', CAST(toxic AS STRING) FROM labels""",
    "sentences": """
        SELECT p_partkey AS id, 'validatePart' || CAST(p_partkey AS STRING) || ' uses supplier_id_' || CAST(p_partkey % 9 AS STRING) ||
               '. See src/parts/mod_' || CAST(p_partkey % 4 AS STRING) || '.py or https://example.org/p/' || CAST(p_partkey AS STRING) ||
               ' and mail ops' || CAST(p_partkey % 7 AS STRING) || '@example.org about Jane Smith. The ' || p_name ||
               ' depends on the ' || lower(p_type) || ' frame, PartStore implements CacheLayer.' AS text
        FROM part""",
    "linked_texts": """
        SELECT doc_id AS id, replace(replace(text, ' the ', ' uses '), ' de ', ' based on ') AS text FROM documents""",
    "plain_sentences": """
        SELECT p_partkey AS id, 'Review of loadPart' || CAST(p_partkey AS STRING) || ' in lib/' || replace(p_name, ' ', '_') ||
               '.rs by Mary Jones with part_key_' || CAST(p_size AS STRING) AS text
        FROM part""",
    "facts": """
        SELECT s_suppkey AS id, 'demo' AS project, s_name AS subject, 'located in' AS predicate, n_name AS object_val,
               CAST(50 + s_suppkey % 50 AS DOUBLE) / 100 AS confidence
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "preferences": """
        SELECT c_custkey AS id, 'proj-' || CAST(c_custkey % 20 AS STRING) AS project, c_mktsegment AS category,
               'prefers ' || lower(c_mktsegment) || ' offers' AS preference, CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence,
               CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS superseded_by,
               TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS created_at
        FROM customer""",
    "lessons": """
        SELECT p_partkey AS id, 'proj-' || CAST(p_partkey % 20 AS STRING) AS project, 'check ' || p_name AS lesson,
               CAST(5 + p_partkey % 96 AS DOUBLE) / 100 AS strength, TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS created_at
        FROM part""",
    "skill_events": """
        SELECT event_type AS project, 'skill-' || CAST(user_id AS STRING) AS skill_name, CAST(ts AS TIMESTAMP) AS demonstrated_at FROM events""",
    "locations": """
        SELECT c_custkey AS id, c_name AS name, 'LOCATION' AS type, 'demo' AS project,
               CAST(c_custkey * 37 % 1800 AS DOUBLE) / 10 - 90 AS latitude, CAST(c_custkey * 53 % 3600 AS DOUBLE) / 10 - 180 AS longitude,
               CAST(40 + c_custkey % 60 AS DOUBLE) / 100 AS confidence
        FROM customer""",
    "points": """
        SELECT s_suppkey AS point_id, CAST(s_suppkey * 41 % 1800 AS DOUBLE) / 10 - 90 AS lat, CAST(s_suppkey * 59 % 3600 AS DOUBLE) / 10 - 180 AS lon
        FROM supplier""",
    "actions": """
        SELECT o_orderkey AS id, 'demo-' || CAST(o_custkey % 3 AS STRING) AS project, 'Order ' || CAST(o_orderkey AS STRING) AS title,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders""",
    "action_deps": """
        SELECT o_orderkey AS action_id, o_orderkey - 3 AS dep_id FROM orders WHERE o_orderpriority <> '1-URGENT'
        UNION ALL
        SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')""",
    "action_groups": """
        SELECT CAST(l_suppkey AS STRING) AS group_id, l_orderkey AS action_id, l_linenumber AS pos FROM lineitem""",
    "lease_log": """
        SELECT event_id, 'act-' || CAST(user_id AS STRING) AS action_id, 'agent-' || event_type AS holder_id, CAST(ts AS TIMESTAMP) AS ts FROM events""",
    "traces": f"""
        SELECT DISTINCT {_id('trace', 'conv_id')} AS id, {_id('sess', 'conv_id')} AS session_id, 'src' || CAST(conv_id % 20 AS STRING) AS project,
               'task ' || CAST(conv_id AS STRING) || ' of area ' || CAST(conv_id % 7 AS STRING) AS task,
               CASE WHEN conv_id % 2 = 0 THEN 'done ' || CAST(conv_id AS STRING) END AS outcome,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '3' HOUR AS started_at
        FROM conversations""",
    "steps": f"""
        SELECT 'step-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, {_id('trace', 'conv_id')} AS trace_id, role AS action, text AS thought,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '3' HOUR + turn * INTERVAL '25' SECOND AS created_at
        FROM conversations""",
    "tool_calls": """
        SELECT 'call-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, 'step-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS step_id,
               'tool-' || CAST(turn % 3 AS STRING) AS tool_name, CASE WHEN turn % 4 = 0 THEN '' ELSE 'error' END AS status
        FROM conversations WHERE role = 'assistant'""",
    "slots": """
        SELECT 'src' || CAST(n_regionkey AS STRING) AS project, n_name AS slot_name,
               CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'remember ' || n_name END AS content
        FROM nation""",
    "slot_changes": """
        SELECT 'proj-' || CAST(user_id % 5 AS STRING) AS project, event_type AS slot_name, 'v' || CAST(event_id AS STRING) AS content, CAST(ts AS TIMESTAMP) AS updated_at
        FROM events""",
    "working_stack": f"""
        SELECT 'wm-' || CAST(event_id AS STRING) AS id, {_id('sess', 'user_id')} AS session_id, props AS content, CAST(ts AS TIMESTAMP) AS pushed_at FROM events""",
    "shares": f"""
        SELECT {_id('mem', 'o_orderkey')} AS memory_id, 'team-' || CAST(o_custkey % 4 AS STRING) AS team_id, 'user-' || CAST(o_custkey AS STRING) AS shared_by,
               CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'edit' END AS mode, CAST(o_orderdate AS TIMESTAMP) AS shared_at
        FROM orders""",
    "share_requests": f"""
        SELECT {_id('mem', 'l_orderkey')} AS memory_id, 'team-' || CAST(l_suppkey % 4 AS STRING) AS team_id, 'user-' || CAST(l_partkey AS STRING) AS shared_by,
               CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'edit' WHEN 2 THEN 'read' ELSE 'own' END AS mode,
               CAST(l_shipdate AS TIMESTAMP) + l_linenumber * INTERVAL '1' SECOND AS ts
        FROM lineitem""",
    "audit": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, 'user-' || CAST(user_id AS STRING) AS actor,
               CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'share' ELSE 'link' END AS action, props AS payload
        FROM events""",
    "delete_requests": f"""
        SELECT {_id('mem', 'l_orderkey')} AS memory_id, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE '' END AS reason,
               CASE WHEN l_linestatus = 'O' THEN '' ELSE 'auditor' END AS actor
        FROM lineitem""",
    "enrichment": """
        SELECT 'OBJECT' AS type, upper(p_name || ' ' || CAST(p_partkey AS STRING)) AS name, p_brand AS summary,
               TIMESTAMP '2024-01-20 00:00:00' - p_size * INTERVAL '8' HOUR AS fetched_at
        FROM part""",
    "model_replies": f"""
        SELECT 'obs-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, {_id('sess', 'conv_id')} AS session_id, 'user_prompt' AS hook_type, role AS tool_name,
               CAST(NULL AS STRING) AS tool_input, text AS tool_output, CAST(NULL AS STRING) AS user_prompt,
               CASE turn % 4 WHEN 3 THEN 'no envelope: ' || text
                    ELSE 'Sure.' || chr(10) || '<compressed><type>' || role || '</type><title>turn ' || CAST(turn AS STRING) || '</title><narrative>' ||
                         replace(replace(text, '&', ''), '<', '') || '</narrative><facts><fact> one </fact><fact>two</fact></facts><concepts><concept>' || role ||
                         '</concept></concepts><importance>' || CAST(turn AS STRING) || '</importance>' ||
                         CASE WHEN turn % 4 = 2 THEN '<files><file>a.py</file>' ELSE '' END || '</compressed>' END AS reply
        FROM conversations""",
    "context_requests": f"""
        SELECT DISTINCT conv_id AS request_id, 'src' || CAST(conv_id % 20 AS STRING) AS project, {_id('sess', 'conv_id')} AS session_id,
               CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'area ' || CAST(conv_id % 7 AS STRING) ELSE 'Located In' END AS query
        FROM conversations""",
    "query_log": """
        SELECT CASE event_type WHEN 'click' THEN 'bm25' WHEN 'view' THEN 'vector' ELSE 'hybrid' END AS mode, value / 100 AS seconds, CAST(ts AS TIMESTAMP) AS ts FROM events""",
}

_BASE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(BASE_TABLES) + r")\b")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a base table by its own name."""
    if name in BASE_TABLES:
        return read_table(spark, f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{arr}", "array")
    tables = {t: read_table(spark, f"{sf_dir}/{t}.parquet") for _, t in set(_BASE.findall(sql))}
    # Braces that belong to JSON text are literal, only table names are parameters.
    sql = _BASE.sub(r"\1 {\2}", sql.replace("{{", "\u0001").replace("}}", "\u0002").replace("{", "{{").replace("}", "}}"))
    return spark.sql(sql.replace("\u0001", "{{").replace("\u0002", "}}"), **tables)


def oracle_view(name: str) -> str:
    return VIEWS[name].replace("{arr}", "list_value").replace("{{", "{").replace("}}", "}")
