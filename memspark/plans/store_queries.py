"""Queries on lookups, searches, context, governance, orchestration and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memspark.operators import governance as gov, orchestration as orch, upserts as up, views as vw
from memspark.operators.context import assemble_context
from memspark.plans.registry import View, query
from memspark.plans.views import NOW
from memspark.sources.bundles import insert_absent, manifest, merge_tables, select_bundle
from memspark.sources.transcripts import import_transcript


@query(
    "timeline", ["observations"],
    """SELECT id, session_id, hook_type, title, created_at FROM observations WHERE project = 'src3' AND created_at > TIMESTAMP '2024-01-01 00:00:00'
       AND created_at < TIMESTAMP '2024-03-01 00:00:00' ORDER BY created_at, id LIMIT 50""",
)
def timeline(v: View) -> DataFrame:
    found = vw.timeline(v("observations"), project="src3", after="2024-01-01 00:00:00", before="2024-03-01 00:00:00")
    return found.select("id", "session_id", "hook_type", "title", "created_at")


@query(
    "timeline_file", ["observations"],
    """SELECT id, created_at FROM observations WHERE hook_type = 'user_prompt' AND list_contains(files, 'docs/en.md') ORDER BY created_at, id LIMIT 50""",
)
def timeline_file(v: View) -> DataFrame:
    return vw.timeline(v("observations"), hook="user_prompt", file="docs/en.md").select("id", "created_at")


@query(
    "file_history", ["observations"],
    "SELECT id, session_id, tool_name, created_at FROM observations WHERE compressed AND list_contains(files, 'docs/en.md') ORDER BY created_at, id LIMIT 50",
)
def file_history(v: View) -> DataFrame:
    return vw.file_history(v("observations"), "docs/en.md").select("id", "session_id", "tool_name", "created_at")


@query("list_observations", ["observations"], "SELECT id, created_at FROM observations WHERE project = 'src1' ORDER BY created_at DESC, id LIMIT 50")
def list_observations(v: View) -> DataFrame:
    return vw.list_observations(v("observations"), project="src1").select("id", "created_at")


@query("list_sessions", ["sessions"], "SELECT id, project, started_at FROM sessions WHERE status = 'active' ORDER BY started_at DESC, id LIMIT 50")
def list_sessions(v: View) -> DataFrame:
    return vw.list_sessions(v("sessions"), status="active").select("id", "project", "started_at")


@query(
    "list_actions", ["actions"],
    "SELECT id, project, priority FROM actions WHERE project = 'demo-1' AND status = 'pending' ORDER BY priority, created_at, id LIMIT 50",
)
def list_actions(v: View) -> DataFrame:
    return vw.list_actions(v("actions"), "demo-1", "pending").select("id", "project", "priority")


@query("list_slots", ["slots"], "SELECT project, slot_name, content FROM slots WHERE project = 'src2'")
def list_slots(v: View) -> DataFrame:
    return vw.list_slots(v("slots"), "src2").select("project", "slot_name", "content")


@query("forget", ["memories", "delete_requests"], "SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM delete_requests)")
def forget(v: View) -> DataFrame:
    return gov.forget(v("memories"), v("delete_requests"), NOW)[0].select("id")


@query("memories_by_tier", ["memories"], "SELECT id, strength FROM memories WHERE tier = 'semantic' ORDER BY strength DESC, created_at DESC, id LIMIT 50")
def memories_by_tier(v: View) -> DataFrame:
    return vw.memories_by_tier(v("memories"), tier="semantic").select("id", "strength")


@query("latest_memories", ["memories"], "SELECT id, strength FROM memories WHERE project = 'proj-3' AND is_latest ORDER BY strength DESC, id LIMIT 25")
def latest_memories(v: View) -> DataFrame:
    return vw.latest_memories(v("memories"), "proj-3").select("id", "strength")


@query("memories_by_id", ["memories", "memory_facets"], "SELECT id, title FROM memories WHERE id IN (SELECT memory_id FROM memory_facets)")
def memories_by_id(v: View) -> DataFrame:
    return vw.by_keys(v("memories"), v("memory_facets").select(F.col("memory_id").alias("id"))).select("id", "title")


@query(
    "text_search_memories", ["memories"],
    "SELECT id, strength FROM memories WHERE contains(lower(title), 'urgent') OR contains(lower(content), 'urgent') ORDER BY strength DESC, id LIMIT 10",
)
def text_search_memories(v: View) -> DataFrame:
    return vw.search_memories(v("memories"), "URGENT").select("id", "strength")


@query("text_search_messages", ["messages"], "SELECT id, created_at FROM messages WHERE contains(lower(content), 'the ') ORDER BY created_at DESC, id LIMIT 20")
def text_search_messages(v: View) -> DataFrame:
    return vw.search_messages(v("messages"), "The ").select("id", "created_at")


@query(
    "text_search_preferences", ["preferences"],
    """SELECT id, confidence FROM preferences WHERE superseded_by IS NULL AND category = 'BUILDING' AND contains(lower(preference), 'offers')
       ORDER BY confidence DESC, created_at DESC, id LIMIT 20""",
)
def text_search_preferences(v: View) -> DataFrame:
    return vw.search_preferences(v("preferences"), "offers", category="BUILDING").select("id", "confidence")


@query(
    "text_search_facts", ["facts"],
    "SELECT id, confidence FROM facts WHERE predicate = 'located in' AND contains(lower(subject || ' ' || predicate || ' ' || object_val), 'located in nation_1') ORDER BY confidence DESC, id LIMIT 20",
)
def text_search_facts(v: View) -> DataFrame:
    return vw.search_facts(v("facts"), "located in NATION_1", predicate="located in").select("id", "confidence")


@query("text_search_traces", ["traces"], "SELECT id, task FROM traces WHERE contains(lower(task), 'area 3') ORDER BY started_at DESC, id LIMIT 20")
def text_search_traces(v: View) -> DataFrame:
    return vw.search_traces(v("traces"), "Area 3").select("id", "task")


@query("text_search_lessons", ["lessons"], "SELECT id, strength FROM lessons WHERE contains(lower(lesson), 'ring') ORDER BY strength DESC, created_at DESC, id LIMIT 20")
def text_search_lessons(v: View) -> DataFrame:
    return vw.search_lessons(v("lessons"), "ring").select("id", "strength")


@query(
    "text_search_skills", ["skill_events"],
    """SELECT project, skill_name, count(*) AS evidence_count FROM skill_events WHERE contains(lower(skill_name), 'skill-1') GROUP BY project, skill_name
       ORDER BY evidence_count DESC, project, skill_name LIMIT 20""",
)
def text_search_skills(v: View) -> DataFrame:
    from memspark.operators.mining import skills_rollup

    return vw.search_skills(skills_rollup(v("skill_events")), "SKILL-1").select("project", "skill_name", "evidence_count")


@query(
    "locations_near", ["locations"],
    f"""SELECT id, name, confidence FROM locations WHERE type = 'LOCATION' AND latitude BETWEEN 10 - {2000 / 111.0!r} AND 10 + {2000 / 111.0!r}
        AND longitude BETWEEN 20 - {2000 / 111.0!r} AND 20 + {2000 / 111.0!r} ORDER BY confidence DESC, id LIMIT 20""",
)
def locations_near(v: View) -> DataFrame:
    return vw.locations_near(v("locations"), 10, 20, 2000).select("id", "name", "confidence")


@query(
    "locations_near_points", ["points", "locations"],
    f"""SELECT point_id, location_id, confidence, rank FROM (
        SELECT point_id, l.id AS location_id, l.confidence, row_number() OVER (PARTITION BY point_id ORDER BY l.confidence DESC, l.id) AS rank
        FROM points JOIN locations l ON latitude BETWEEN lat - {500 / 111.0!r} AND lat + {500 / 111.0!r} AND longitude BETWEEN lon - {500 / 111.0!r} AND lon + {500 / 111.0!r}) r WHERE rank <= 20""",
)
def locations_near_points(v: View) -> DataFrame:
    return vw.locations_near_points(v("points"), v("locations"), 500).select("point_id", "location_id", "confidence", "rank")


@query(
    "facet_query", ["memories", "memory_facets"],
    """SELECT id, strength FROM memories m WHERE EXISTS (SELECT 1 FROM memory_facets f WHERE f.memory_id = m.id AND f.dimension = 'quality' AND f.value = '1')
       AND EXISTS (SELECT 1 FROM memory_facets f WHERE f.memory_id = m.id AND f.dimension = 'toxic' AND f.value = '0') ORDER BY strength DESC, id LIMIT 20""",
)
def facet_query(v: View) -> DataFrame:
    return vw.query_facets(v("memories"), v("memory_facets"), [("quality", "1"), ("toxic", "0")]).select("id", "strength")


@query(
    "conversation_view", ["messages"],
    "SELECT session_id, id, role, pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS pos FROM messages) m WHERE pos <= 200",
)
def conversation_view(v: View) -> DataFrame:
    return vw.conversation_view(v("messages")).select("session_id", "id", "role", "pos")


@query(
    "conversations", ["messages"],
    "SELECT session_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS messages FROM messages GROUP BY session_id",
)
def conversations(v: View) -> DataFrame:
    return up.ensure_conversations(v("messages")).drop("id")


@query("trace_steps", ["steps"], "SELECT id, trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) - 1 AS INTEGER) AS step_index FROM steps")
def trace_steps(v: View) -> DataFrame:
    return vw.number_steps(v("steps"), ["created_at", "id"]).select("id", "trace_id", "step_index")


@query(
    "trace_tree", ["traces", "steps", "tool_calls"],
    """WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY created_at, id) - 1 AS INTEGER) AS step_index FROM steps)
       SELECT t.id AS trace_id, t.task, s.id AS step_id, s.step_index, s.action, c.tool_name, CASE WHEN c.status = '' THEN 'success' ELSE c.status END AS call_status
       FROM traces t LEFT JOIN s ON s.trace_id = t.id LEFT JOIN tool_calls c ON c.step_id = s.id""",
)
def trace_tree(v: View) -> DataFrame:
    steps = vw.number_steps(v("steps"), ["created_at", "id"])
    return vw.trace_tree(v("traces"), steps, v("tool_calls")).select("trace_id", "task", "step_id", "step_index", "action", "tool_name", "call_status")


_LIKE = "(r.query = '' OR contains(lower({}), lower(r.query)))"


def _lines(name: str, source: str, match: str, text: str, order: str, line: str, k: int) -> str:
    return f"""
        {name}_r AS (SELECT r.request_id, {line} AS line, row_number() OVER (PARTITION BY r.request_id ORDER BY {order}) AS rn FROM context_requests r JOIN {source} x ON {match}{' AND ' + _LIKE.format(text) if text else ''}),
        {name}_t AS (SELECT request_id, string_agg(line, '' ORDER BY rn) AS t, count(*) AS n FROM {name}_r WHERE rn <= {k} GROUP BY request_id)"""


def _dots(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n - 3}) || '...' ELSE {x} END"


_CONTEXT = ",".join(
    [
        _lines("mem", "(SELECT *, 'src' || right(project, 1) AS p FROM memories WHERE tier = 'semantic')", "x.p = r.project", "", "x.strength DESC, x.created_at DESC, x.id",
               f"'- **' || x.title || '**: ' || {_dots('x.content', 200)} || chr(10)", 10),
        _lines("pre", "(SELECT *, 'src' || right(project, 1) AS p FROM preferences WHERE superseded_by IS NULL)", "x.p = r.project", "x.preference",
               "x.confidence DESC, x.created_at DESC, x.id", "'- [' || x.category || '] ' || x.preference || chr(10)", 5),
        _lines("fac", "facts", "r.project <> 'none'", "x.subject || ' ' || x.predicate || ' ' || x.object_val", "x.confidence DESC, x.id",
               "'- ' || x.subject || ' ' || x.predicate || ' ' || x.object_val || chr(10)", 5),
        _lines("msg", "messages", "x.session_id = r.session_id", "", "x.created_at, x.id", f"'**' || x.role || '**: ' || {_dots('x.content', 300)} || chr(10)", 10),
        _lines("tra", "(SELECT *, coalesce(nullif(outcome, ''), 'in progress') AS out FROM traces)", "x.project = r.project AND r.query <> ''", "x.task", "x.started_at DESC, x.id",
               f"'- Task: ' || x.task || ' → ' || {_dots('x.out', 100)} || chr(10)", 5),
    ]
)


@query(
    "context_assembly", ["context_requests", "memories", "preferences", "facts", "messages", "traces", "slots"],
    f"""WITH {_CONTEXT},
        slo_t AS (SELECT project, string_agg(CASE WHEN content <> '' THEN '### ' || slot_name || chr(10) || content || chr(10) ELSE '' END, '' ORDER BY slot_name) AS t, count(*) AS n FROM slots GROUP BY project),
        whole AS (SELECT r.request_id, concat_ws(chr(10), '## Memories' || chr(10) || mem_t.t, '## Preferences' || chr(10) || pre_t.t, '## Facts' || chr(10) || fac_t.t,
                  '## Recent Conversation' || chr(10) || msg_t.t, '## Past Reasoning' || chr(10) || tra_t.t, '## Pinned Context' || chr(10) || slo_t.t) AS context,
                  coalesce(mem_t.n, 0) AS n_memories, coalesce(pre_t.n, 0) AS n_preferences, coalesce(fac_t.n, 0) AS n_facts, coalesce(msg_t.n, 0) AS n_messages,
                  coalesce(tra_t.n, 0) AS n_traces, coalesce(slo_t.n, 0) AS n_slots
          FROM context_requests r LEFT JOIN mem_t USING (request_id) LEFT JOIN pre_t USING (request_id) LEFT JOIN fac_t USING (request_id) LEFT JOIN msg_t USING (request_id)
          LEFT JOIN tra_t USING (request_id) LEFT JOIN slo_t ON slo_t.project = r.project)
        SELECT *, CAST(floor(len(regexp_extract_all(context, '\\S+')) * 4 / 3) AS INTEGER) AS token_estimate FROM whole""",
)
def context_assembly(v: View) -> DataFrame:
    # The stores use other project names than the requests; facts are shared by all and asked for once per project.
    renamed = F.concat(F.lit("src"), F.substring("project", -1, 1))
    requests = v("context_requests")
    shared = v("facts").drop("project").withColumn("project", F.explode(F.array(*[F.lit(f"src{i}") for i in range(20)])))
    out = assemble_context(
        requests, v("memories").withColumn("project", renamed), v("preferences").withColumn("project", renamed), shared, v("messages"), v("traces"), v("slots")
    )
    return out.drop("project", "session_id", "query")


@query(
    "working_pop", ["working_stack"],
    "SELECT id, session_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pushed_at DESC, id DESC) AS rank FROM working_stack) w WHERE rank <= 3",
)
def working_pop(v: View) -> DataFrame:
    return up.working_pop(v("working_stack"), 3)[0].select("id", "session_id", "rank")


@query(
    "slots_latest", ["slots", "slot_changes"],
    """SELECT project, slot_name, arg_max(content, updated_at) AS content FROM slot_changes GROUP BY project, slot_name UNION ALL SELECT project, slot_name, content FROM slots""",
)
def slots_latest(v: View) -> DataFrame:
    old = v("slots").withColumn("updated_at", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return up.set_slots(old, v("slot_changes")).drop("updated_at")


_SHARES = """good AS (SELECT memory_id, team_id, shared_by, CASE WHEN mode = '' THEN 'read' ELSE mode END AS mode, ts FROM share_requests
      WHERE mode IN ('', 'read', 'edit') AND memory_id IN (SELECT id FROM memories)),
    stacked AS (SELECT memory_id, team_id, shared_by, mode, shared_at AS ts FROM shares UNION ALL SELECT memory_id, team_id, shared_by, mode, ts FROM good)"""


@query(
    "share_memories", ["shares", "share_requests", "memories"],
    f"""WITH {_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY memory_id, team_id ORDER BY ts DESC, mode DESC, shared_by DESC) AS k, min(ts) OVER (PARTITION BY memory_id, team_id) AS shared_at FROM stacked)
        SELECT memory_id, team_id, shared_by, mode, shared_at FROM r WHERE k = 1""",
)
def share_memories(v: View) -> DataFrame:
    return gov.share_memories(v("shares"), v("share_requests"), v("memories"), NOW)[0]


@query(
    "share_rejected", ["share_requests", "memories"],
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN mode NOT IN ('', 'read', 'edit') THEN 'mode must be read or edit'
       WHEN memory_id NOT IN (SELECT id FROM memories) THEN 'memory not found' END AS reason FROM share_requests) x WHERE reason IS NOT NULL GROUP BY reason""",
)
def share_rejected(v: View) -> DataFrame:
    rejected = gov.share_memories(v("shares"), v("share_requests"), v("memories"), NOW)[3]
    return rejected.groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "revoke_shares", ["shares", "share_requests"],
    "SELECT memory_id, team_id, mode FROM shares s WHERE NOT EXISTS (SELECT 1 FROM share_requests r WHERE r.memory_id = s.memory_id AND r.team_id = s.team_id)",
)
def revoke_shares(v: View) -> DataFrame:
    asked = v("share_requests").withColumnRenamed("shared_by", "actor")
    return gov.revoke_shares(v("shares"), asked, NOW)[0].select("memory_id", "team_id", "mode")


@query(
    "team_feed", ["shares", "memories"],
    """SELECT f.memory_id, f.shared_by, f.shared_at, coalesce(m.title, '') AS title, coalesce(m.content, '') AS content
       FROM (SELECT * FROM shares WHERE team_id = 'team-1' ORDER BY shared_at DESC, memory_id LIMIT 50) f LEFT JOIN memories m ON m.id = f.memory_id""",
)
def team_feed(v: View) -> DataFrame:
    return gov.team_feed(v("shares"), v("memories"), "team-1").select("memory_id", "shared_by", "shared_at", "title", "content")


@query("audit_query", ["audit"], "SELECT id, actor, action, payload FROM audit WHERE action = 'delete' AND contains(payload, '7') ORDER BY ts DESC, id DESC LIMIT 200")
def audit_query(v: View) -> DataFrame:
    return gov.audit_query(v("audit"), action="delete", project="7").select("id", "actor", "action", "payload")


@query("governance_delete", ["memories", "delete_requests"], "SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM delete_requests WHERE reason <> '')")
def governance_delete(v: View) -> DataFrame:
    return gov.governance_delete(v("memories"), v("delete_requests"), NOW)[0].select("id")


@query(
    "governance_audit", ["delete_requests"],
    """SELECT memory_id AS target_id, 'governance_delete' AS action, CASE WHEN actor = '' THEN 'governance' ELSE actor END AS actor,
       '{"actor":"' || CASE WHEN actor = '' THEN 'governance' ELSE actor END || '","reason":"' || reason || '"}' AS payload FROM delete_requests WHERE reason <> ''""",
)
def governance_audit(v: View) -> DataFrame:
    return gov.governance_delete(v("memories"), v("delete_requests"), NOW)[1].select("target_id", "action", "actor", "payload")


@query(
    "audit_trail", ["memories", "delete_requests"],
    """WITH d AS (SELECT DISTINCT memory_id, reason, CASE WHEN actor = '' THEN 'governance' ELSE actor END AS actor FROM delete_requests WHERE reason <> ''),
       days AS (SELECT d.*, day FROM d, (SELECT unnest(range(0, 10)) AS day)),
       a AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + day * INTERVAL '1' DAY AS ts, memory_id AS target_id, actor FROM days WHERE memory_id LIKE '%' || day),
       n AS (SELECT ts, target_id, actor, max(ts) OVER () AS newest FROM a)
       SELECT ts, count(*) AS n FROM n GROUP BY ts""",
)
def audit_trail(v: View) -> DataFrame:
    """Deletions of ten days, a tenth of all requests on each, as audited; the query gives them newest first."""
    requests = v("delete_requests").distinct()
    audit = None
    for day in range(10):
        _, rows, _ = gov.governance_delete(v("memories"), requests.filter(F.col("memory_id").endswith(str(day))), f"2024-01-{day + 1:02d} 00:00:00")
        audit = rows if audit is None else audit.unionByName(rows)
    return gov.audit_query(audit, action="governance_delete", limit=2**31 - 1).groupBy("ts").agg(F.count_distinct("id").alias("n"))


@query(
    "audit_newest", ["memories", "delete_requests"],
    """SELECT DISTINCT memory_id AS target_id, TIMESTAMP '2024-01-03 00:00:00' AS ts FROM delete_requests WHERE reason <> ''""",
)
def audit_newest(v: View) -> DataFrame:
    """Of two days of deletions the newer day's, by the limit of the query alone."""
    gone = v("delete_requests").distinct()
    older = gov.governance_delete(v("memories"), gone, "2024-01-02 00:00:00")[1]
    newer = gov.governance_delete(v("memories"), gone, "2024-01-03 00:00:00")[1]
    shown = newer.count()
    return gov.audit_query(older.unionByName(newer), limit=shown).select("target_id", "ts").distinct()


@query(
    "archive_report", ["messages"],
    f"""WITH c AS (SELECT conversation_id, max(created_at) AS u FROM messages GROUP BY conversation_id HAVING max(created_at) < TIMESTAMP '{NOW}' - INTERVAL '10' DAY)
        SELECT (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM messages WHERE conversation_id IN (SELECT conversation_id FROM c)) AS messages""",
)
def archive_report(v: View) -> DataFrame:
    m = v("messages")
    conversations = m.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("updated_at"))
    return gov.archive_messages(m, conversations, NOW, ttl_days=10)[1]


_FRONTIER = """ready AS (SELECT * FROM actions a WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM action_deps d WHERE d.action_id = a.id
    AND NOT EXISTS (SELECT 1 FROM actions x WHERE x.id = d.dep_id AND x.project = a.project AND x.status = 'completed')))"""


@query("action_frontier", ["actions", "action_deps"], f"WITH {_FRONTIER} SELECT id, project, priority FROM ready")
def action_frontier(v: View) -> DataFrame:
    return orch.frontier(v("actions"), v("action_deps")).select("id", "project", "priority")


@query(
    "next_action", ["actions", "action_deps"],
    f"WITH {_FRONTIER} SELECT project, id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority, created_at, id) AS rn FROM ready) r WHERE rn = 1",
)
def next_action(v: View) -> DataFrame:
    return orch.next_action(v("actions"), v("action_deps")).select("project", "id")


@query(
    "crystallize", ["actions", "action_groups"],
    f"""SELECT group_id, project, 'Crystallized: ' || CAST(count(*) AS VARCHAR) || ' actions' AS title,
        string_agg(title, '; ' ORDER BY pos, action_id) FILTER (WHERE rn <= {orch.SHOWN}) AS description, 'completed' AS status, count(*) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY group_id, project ORDER BY pos, action_id) AS rn FROM action_groups JOIN actions ON id = action_id) x GROUP BY group_id, project""",
)
def crystallize(v: View) -> DataFrame:
    return orch.crystallize(v("action_groups"), v("actions")).drop("id")


@query("crystallize_lines", ["actions", "action_groups"], "SELECT group_id, project, pos, action_id, title FROM action_groups JOIN actions ON id = action_id")
def crystallize_lines(v: View) -> DataFrame:
    return orch.crystallize_lines(v("action_groups"), v("actions"))


@query(
    "sentinel_match", ["hooks"],
    """WITH s AS (SELECT DISTINCT 'sen-' || project || tool_name AS id, project, tool_name AS event_pattern FROM hooks UNION SELECT 'sen-none', 'proj-1', 'crash')
       SELECT s.id, min(h.ts) AS triggered_at FROM s LEFT JOIN hooks h ON h.project = s.project AND h.tool_name = s.event_pattern GROUP BY s.id""",
)
def sentinel_match(v: View) -> DataFrame:
    h = v("hooks")
    watched = h.select(F.concat(F.lit("sen-"), "project", "tool_name").alias("id"), "project", F.col("tool_name").alias("event_pattern")).distinct()
    one = h.select(F.lit("sen-none").alias("id"), F.lit("proj-1").alias("project"), F.lit("crash").alias("event_pattern")).distinct()
    return orch.match_sentinels(watched.unionByName(one), h.withColumnRenamed("tool_name", "event_type")).select("id", "triggered_at")


@query("inbox", ["lease_log"], "SELECT event_id AS id, ts AS created_at FROM lease_log WHERE holder_id = 'agent-click'")
def inbox(v: View) -> DataFrame:
    signals = v("lease_log").select(F.col("event_id").alias("id"), F.col("holder_id").alias("to"), F.col("ts").alias("created_at"))
    return orch.inbox(signals, "agent-click").select("id", "created_at")


@query("status_report", ["sessions", "observations", "memories"], "SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM observations) AS observations, (SELECT count(*) FROM memories) AS memories")
def status_report(v: View) -> DataFrame:
    return vw.status_report(v("sessions"), v("observations"), v("memories"))


@query(
    "recall_marks", ["memories", "shares"],
    """SELECT m.id, greatest(m.last_retrieved_at, s.ts) AS last_retrieved_at FROM memories m LEFT JOIN (SELECT memory_id, max(shared_at) AS ts FROM shares GROUP BY memory_id) s ON s.memory_id = m.id""",
)
def recall_marks(v: View) -> DataFrame:
    log = v("shares").select("memory_id", F.col("shared_at").alias("ts"))
    return vw.mark_retrieved(v("memories"), log).select("id", "last_retrieved_at")


@query(
    "remember", ["new_memories", "memories"],
    """SELECT project, 'fact' AS type, 'semantic' AS tier, CASE WHEN length(content) > 60 THEN left(content, 57) || '...' ELSE content END AS title, content, 1.0 AS strength, count(*) AS n
       FROM new_memories GROUP BY ALL""",
)
def remember(v: View) -> DataFrame:
    new = v("new_memories").select("project", "content", F.lit("").alias("type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("tier"), F.lit(0.0).alias("strength"))
    table, _, _ = up.remember(v("memories"), new, NOW)
    added = table.filter(F.col("created_at") == F.lit(NOW).cast("timestamp"))
    return added.groupBy("project", "type", "tier", "title", "content", "strength").agg(F.count_distinct("id").alias("n"))


@query(
    "ensure_users", ["audit"],
    """SELECT identifier, min(created_at) AS created_at FROM (SELECT 'user-' || CAST(n_nationkey AS VARCHAR) AS identifier, TIMESTAMP '2000-01-01 00:00:00' AS created_at FROM nation
       UNION ALL SELECT actor, ts FROM audit) x GROUP BY identifier""",
)
def ensure_users(v: View) -> DataFrame:
    seen = v("audit").select(F.col("actor").alias("identifier"), "ts")
    name = F.concat(F.lit("user-"), F.col("n_nationkey").cast("string"))
    old = v("nation").select(name.alias("id"), name.alias("identifier"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("created_at"))
    return up.ensure_users(old, seen).select("identifier", "created_at")


@query("add_facets", ["memory_facets"], "SELECT DISTINCT memory_id, dimension, value FROM memory_facets")
def add_facets(v: View) -> DataFrame:
    stamped = v("memory_facets").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    return up.add_facets(stamped.filter("dimension = 'toxic'"), stamped).select("memory_id", "dimension", "value")


@query(
    "complete_traces", ["traces", "steps"],
    """SELECT t.id, arg_max('ended by ' || s.action, s.created_at) AS outcome, max(s.created_at) AS completed_at FROM traces t JOIN steps s ON s.trace_id = t.id GROUP BY t.id""",
)
def complete_traces(v: View) -> DataFrame:
    ends = v("steps").select("trace_id", F.concat(F.lit("ended by "), "action").alias("outcome"), F.lit(True).alias("success"), F.col("created_at").alias("ts"))
    return up.complete_traces(v("traces"), ends).select("id", "outcome", "completed_at")


@query(
    "bundle_manifest", ["sessions", "observations"],
    """SELECT 'sessions' AS "table", count(*) AS "rows" FROM sessions WHERE project = 'src3' UNION ALL SELECT 'observations', count(*) FROM observations WHERE project = 'src3' AND compressed""",
)
def bundle_manifest(v: View) -> DataFrame:
    return manifest(select_bundle({"sessions": v("sessions"), "observations": v("observations")}, "src3"))


@query("peer_merge", ["sessions", "observations"], "SELECT id FROM sessions UNION SELECT DISTINCT session_id FROM observations")
def peer_merge(v: View) -> DataFrame:
    return insert_absent(v("sessions"), v("observations").select(F.col("session_id").alias("id"), "project")).select("id")


@query(
    "peer_merge_since", ["sessions"],
    """SELECT id FROM sessions WHERE status = 'active' OR started_at > TIMESTAMP '2024-01-10 00:00:00'""",
)
def peer_merge_since(v: View) -> DataFrame:
    """A peer's sessions started after a time join our active ones."""
    return merge_tables({"sessions": v("sessions").filter("status = 'active'")}, {"sessions": v("sessions")}, since="2024-01-10 00:00:00")["sessions"].select("id")


_LINES = """CASE role WHEN 'user' THEN '{"type":"tool_use","turn":' || CAST(turn AS STRING) || ',"conv":' || CAST(conv_id AS STRING) || '}'
    WHEN 'assistant' THEN '{"type":"message"}' ELSE 'not json' END"""


@query(
    "transcript_import", [],
    f"""SELECT 'imp-sess-imp-' || CAST(conv_id * 100 + turn AS VARCHAR) AS id, '{{"conv":' || CAST(conv_id AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR) || ',"type":"tool_use"}}' AS raw,
        TIMESTAMP '{NOW}' + (conv_id * 100 + turn) * INTERVAL '1' MILLISECOND AS created_at FROM conversations WHERE role = 'user'""",
)
def transcript_import(v: View) -> DataFrame:
    lines = v("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), F.expr(_LINES).alias("value"))
    return import_transcript(lines, "demo", "sess-imported", NOW).select("id", "raw", "created_at")


@query(
    "transcript_import_files", [],
    f"""SELECT 'imp-sess-imp-' || substr(sha256('file-' || CAST(conv_id AS VARCHAR)), 1, 8) || '-' || CAST(turn AS VARCHAR) AS id,
        TIMESTAMP '{NOW}' + turn * INTERVAL '1' MILLISECOND AS created_at FROM conversations WHERE role = 'user'""",
)
def transcript_import_files(v: View) -> DataFrame:
    """One file per conversation, whose line numbers all begin at nought."""
    lines = v("conversations").select(F.concat(F.lit("file-"), "conv_id").alias("file"), F.col("turn").alias("line_no"), F.expr(_LINES).alias("value"))
    return import_transcript(lines, "demo", "sess-imported", NOW).select("id", "created_at")
