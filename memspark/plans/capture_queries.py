"""Queries on capture, redaction, compression and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memspark.functions import events as ev
from memspark.functions.privacy import SECRET_PATTERNS, redact
from memspark.operators.capture import capture, observation_counts, session_lifecycle
from memspark.operators.extraction import (
    FAMILIES, PHRASE, VERB_TYPES, co_occurrence, extract_entities, extract_relations, extract_verb_relations, merge_entities,
)
from memspark.operators.holds import dedup_window, replay_leases
from memspark.plans import oracle_text as o
from memspark.plans.registry import View, query
from memspark.plans.views import NOW
from memspark.sources.tables import spread


@query("redact_text", [], f"WITH {o.redaction('documents', 'doc_id', 'text')} SELECT k AS doc_id, out AS text FROM redacted")
def redact_text(v: View) -> DataFrame:
    return redact(spread(v("documents").select("doc_id", "text")), "text").select("doc_id", "text")


@query(
    "redact_hits", [],
    f"WITH {o.redaction('documents', 'doc_id', 'text')} SELECT k AS doc_id, {o.hit_names()} AS hits, {' OR '.join(f'h{i}' for i in range(len(SECRET_PATTERNS)))} AS had_secrets FROM redacted",
)
def redact_hits(v: View) -> DataFrame:
    return redact(v("documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("hit_patterns", ",").alias("hits"), "had_secrets")


# Texts with every kind of secret, built from the pages' own addresses.
_SECRETS_SPARK = (
    "url || ' sk-ant-' || md5(url) || ' x sk-proj-' || md5(url) || ' ghp_' || md5(url) || ' AKIA' || upper(substr(md5(url), 1, 16)) || '; aws_secret_access_key = \"'"
    " || md5(url) || 'ABCDEFGH\" xoxb-' || md5(url) || ' AIza' || md5(url) || 'ABC Authorization: Bearer ' || md5(url) || ' password: ' || md5(url)"
    " || ' eyJ' || md5(url) || '.' || md5(url) || '.' || md5(url) || ' <private>' || html || '</private> ' || chr(27) || '[31mred' || chr(27) || '[0m'"
    " || ' -----BEGIN RSA PRIVATE KEY-----' || html || '-----END RSA PRIVATE KEY-----'"
)


@query(
    "redact_secrets", [],
    f"WITH src AS (SELECT page_id, {_SECRETS_SPARK} AS text FROM pages), {o.redaction('src', 'page_id', 'text')} SELECT k AS page_id, out AS text, {o.hit_names()} AS hits FROM redacted",
)
def redact_secrets(v: View) -> DataFrame:
    df = v("pages").select("page_id", F.expr(_SECRETS_SPARK).alias("text"))
    return redact(df, "text").select("page_id", "text", F.array_join("hit_patterns", ",").alias("hits"))


@query(
    "tool_fields", ["hooks"],
    """SELECT event_id, json_extract_string(data, '$.tool_name') AS tool_name, CAST(json_extract(data, '$.tool_input') AS VARCHAR) AS tool_input,
       json_extract_string(data, '$.tool_output') AS tool_output, json_extract_string(data, '$.user_prompt') AS user_prompt FROM hooks""",
)
def tool_fields(v: View) -> DataFrame:
    fields = ["tool_name", "tool_input", "tool_output", "user_prompt"]
    return ev.tool_fields(v("hooks").select("event_id", "data")).select("event_id", *fields)


@query(
    "modality", ["page_payloads"],
    f"""WITH m AS (SELECT id, raw, regexp_extract(raw, {o.lit(ev.DATA_IMAGE)}) AS img FROM page_payloads)
        SELECT id, CASE WHEN img = '' THEN 'text' WHEN strlen(raw) - strlen(img) < 100 THEN 'image' ELSE 'mixed' END AS modality FROM m""",
)
def modality(v: View) -> DataFrame:
    return v("page_payloads").select("id", ev.modality(F.col("raw")).alias("modality"))


_KEY = "sha256(session_id || chr(0) || tool_name || chr(0) || replace(tool_input, ': ', ':'))"


@query("dedup_key", ["hooks"], f"SELECT event_id, {_KEY} AS dedup_key FROM hooks")
def dedup_key(v: View) -> DataFrame:
    return v("hooks").select("event_id", ev.dedup_key(F.col("session_id"), F.col("tool_name"), F.col("tool_input")).alias("dedup_key"))


def _walk(source: str, key: str, hours: float, event: str = "event_id") -> str:
    limit = f"INTERVAL '{int(hours * 3600)}' SECOND"
    return f"""
        ordered AS (SELECT {key} AS k, {event} AS e, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, {event}) AS rn FROM {source}),
        walk(k, rn, e, anchor, dup) AS (
            SELECT k, rn, e, ts, false FROM ordered WHERE rn = 1
            UNION ALL
            SELECT x.k, x.rn, x.e, CASE WHEN x.ts < w.anchor + {limit} THEN w.anchor ELSE x.ts END, x.ts < w.anchor + {limit}
            FROM walk w JOIN ordered x ON x.k = w.k AND x.rn = w.rn + 1)"""


@query("dedup_window", ["hooks"], f"WITH RECURSIVE {_walk('hooks', 'session_id || tool_name', 6)} SELECT e AS event_id, dup AS is_duplicate FROM walk")
def dedup(v: View) -> DataFrame:
    rows = v("hooks").select("event_id", "session_id", "tool_name", "ts")
    return dedup_window(rows, ["session_id", "tool_name"], "ts", "event_id", 6 * 3600).select("event_id", "is_duplicate")


@query(
    "dedup_window_default", ["hooks"],
    f"WITH RECURSIVE {_walk('hooks', 'session_id', 300 / 3600)} SELECT e AS event_id, dup AS is_duplicate FROM walk",
)
def dedup_default(v: View) -> DataFrame:
    rows = v("hooks").select("event_id", "session_id", "ts")
    return dedup_window(rows, ["session_id"], "ts", "event_id", 300).select("event_id", "is_duplicate")


@query(
    "capture_observations", ["hooks"],
    f"""WITH RECURSIVE kept AS (SELECT *, session_id || '|' || tool_name || '|' || tool_input AS dk FROM hooks WHERE hook_type <> 'session_end'),
        {_walk('kept', 'dk', 300 / 3600)}
        SELECT session_id, hook_type, tool_name, replace(tool_input, ': ', ':') AS tool_input, 'value ' || CAST(event_id AS VARCHAR) || ' ***REDACTED***' AS tool_output,
               'run ' || CAST(user_id AS VARCHAR) AS user_prompt, 'text' AS modality, true AS has_secrets, k.ts AS created_at
        FROM kept k JOIN walk w ON w.e = k.event_id JOIN (SELECT event_id AS eid, user_id FROM events) u ON eid = k.event_id WHERE NOT dup""",
)
def capture_observations(v: View) -> DataFrame:
    done = capture(v("hooks").select("hook_type", "session_id", "project", "cwd", "ts", "data"))
    return done.observations.select(
        "session_id", "hook_type", "tool_name", "tool_input", "tool_output", "user_prompt", "modality", "has_secrets", "created_at"
    )


@query(
    "capture_sessions", ["hooks"],
    """SELECT session_id AS id, arg_min(project, ts) AS project, CASE WHEN count(*) FILTER (WHERE hook_type = 'session_end') > 0 THEN 'completed' ELSE 'active' END AS status,
       min(ts) AS started_at, min(ts) FILTER (WHERE hook_type = 'session_end') AS ended_at FROM hooks GROUP BY session_id""",
)
def capture_sessions(v: View) -> DataFrame:
    done = capture(v("hooks").select("hook_type", "session_id", "project", "cwd", "ts", "data"))
    return done.sessions.select("id", "project", "status", "started_at", "ended_at")


_BAD_HOOKS = (
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'mouse' WHEN 'view' THEN 'user_prompt' ELSE 'notification' END AS hook_type,"
    " CASE event_type WHEN 'view' THEN '' ELSE 's' || CAST(user_id AS STRING) END AS session_id,"
    " CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS ts FROM events"
)


@query(
    "validate_hooks", [],
    f"""WITH bad AS ({_BAD_HOOKS}) SELECT event_id, CASE WHEN hook_type NOT IN ({', '.join(o.lit(h) for h in ev.HOOK_TYPES)}) THEN 'invalid hookType'
        WHEN session_id = '' THEN 'sessionId required' WHEN ts IS NULL THEN 'timestamp required' END AS reject_reason FROM bad""",
)
def validate(v: View) -> DataFrame:
    e = v("events")
    bad = e.sparkSession.sql(_BAD_HOOKS.replace("FROM events", "FROM {events}"), events=e)
    return bad.select("event_id", ev.hook_reject_reason(F.col("hook_type"), F.col("session_id"), F.col("ts")).alias("reject_reason"))


@query(
    "validate_memories", ["memories"],
    """SELECT id, CASE WHEN strength * 1.02 > 1 THEN 'strength out of [0,1]' END AS reject_reason FROM memories""",
)
def validate_memories(v: View) -> DataFrame:
    raised = v("memories").withColumn("strength", F.col("strength") * 1.02)
    return ev.memory_reject_reason(raised).select("id", "reject_reason")


@query(
    "patch_compressed", ["raw_observations"],
    """SELECT id, coalesce(tool_name, 'tool_use') AS type, coalesce(tool_name, 'observation') AS title, CAST(least(10, strlen(hook_type)) AS INTEGER) AS importance,
       CASE WHEN user_prompt IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM raw_observations""",
)
def patch(v: View) -> DataFrame:
    rows = v("raw_observations").select(
        "id", "session_id", F.coalesce("tool_name", F.lit("")).alias("type"), F.lit("").alias("title"), F.length("hook_type").alias("importance"),
        F.when(F.col("user_prompt").isNull(), -0.5).otherwise(7.0).alias("confidence"),
    )
    return ev.patch_compressed(rows).select("id", "type", "title", "importance", "confidence")


_FILE_RE2 = r"""(?:^|[\s"'`])((?:\.{0,2}/)?(?:[\w.\-]+/)*[\w.\-]+\.(?:""" + ev.FILE_EXTENSIONS + r")\b)"


def _files_sql(*texts: str) -> str:
    lists = [f"regexp_extract_all(coalesce({t}, ''), {o.lit(_FILE_RE2)}, 1)" for t in texts]
    whole = lists[0]
    for more in lists[1:]:
        whole = f"list_concat({whole}, {more})"
    # Distinct in order of first appearance.
    return f"list_filter({whole}, lambda x, i: list_position({whole}, x) = i)"


_TYPE_SQL = "CASE lower(tool_name) " + " ".join(f"WHEN {o.lit(k)} THEN {o.lit(t)}" for k, t in ev.TOOL_TYPES.items()) + " ELSE 'tool_use' END"


def _clip_sql(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN left({t}, {n - 1}) || '…' ELSE {t} END"


_NARRATIVE = f"concat_ws(' | ', coalesce(tool_name, hook_type), nullif(tool_input, ''), nullif({_clip_sql('tool_output', 400)}, ''))"


@query(
    "synthetic_compress", ["raw_observations"],
    f"""WITH f AS (SELECT *, {_files_sql('tool_input', 'tool_output', 'user_prompt')} AS fs, {_NARRATIVE} AS n FROM raw_observations)
        SELECT id, session_id, CASE WHEN coalesce(tool_name, '') = '' THEN 'user_event' ELSE {_TYPE_SQL} END AS type, coalesce(tool_name, hook_type) AS title,
               coalesce(fs[1], '') AS subtitle, {_clip_sql('n', 1000)} AS narrative, array_to_string(fs, ',') AS files, CAST(5 AS INTEGER) AS importance, 0.3 AS confidence FROM f""",
)
def synthetic_compress(v: View) -> DataFrame:
    return ev.compress(v("raw_observations")).select(
        "id", "session_id", "type", "title", "subtitle", "narrative", F.array_join("files", ",").alias("files"), "importance", "confidence"
    )


@query("extract_files", ["sentences"], f"SELECT id, array_to_string({_files_sql('text')}, ',') AS files FROM sentences")
def extract_files(v: View) -> DataFrame:
    return v("sentences").select("id", F.array_join(ev.extract_files(F.col("text")), ",").alias("files"))


@query(
    "parse_replies", ["model_replies"],
    """WITH e AS (SELECT *, regexp_extract(reply, '(?s)<compressed>.*?</compressed>') AS env, CAST(regexp_extract(id, '-([0-9]+)$', 1) AS INTEGER) AS turn FROM model_replies)
       SELECT id, CASE WHEN env = '' THEN 'tool_use' ELSE tool_name END AS type, CASE WHEN env = '' THEN tool_name ELSE 'turn ' || CAST(turn AS VARCHAR) END AS title,
              CASE WHEN env = '' THEN '' ELSE 'one|two' END AS facts, CASE WHEN env = '' THEN '' ELSE tool_name END AS concepts,
              CASE WHEN env <> '' AND turn % 4 = 2 THEN 'a.py' ELSE '' END AS files, CASE WHEN env = '' THEN 5 ELSE turn END AS importance,
              CASE WHEN env = '' THEN 0.3 WHEN turn % 4 = 2 THEN 0.7 ELSE 0.85 END AS confidence FROM e""",
)
def parse_replies(v: View) -> DataFrame:
    done = ev.parse_compression_reply(v("model_replies"))
    return done.select(
        "id", "type", "title", F.array_join("facts", "|").alias("facts"), F.array_join("concepts", "|").alias("concepts"),
        F.when(F.col("parsed"), F.array_join("files", "|")).otherwise("").alias("files"), "importance", "confidence",
    )


def _entities_sql(source: str) -> str:
    """CTEs files, firsts and entities (id, name, type, subtype, confidence)."""
    plain = lambda p: p.replace("(?U)", "")

    def family(i: int, outside: bool) -> str:
        _, pattern, kind, subtype, confidence = FAMILIES[i]
        skip = " WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = n.id AND contains(f.name, n.name))" if outside else ""
        return (
            f"SELECT id, name, '{kind}' AS type, '{subtype}' AS subtype, {confidence} AS confidence FROM "
            f"(SELECT id, unnest(list_distinct(regexp_extract_all(text, {o.lit(plain(pattern))}))) AS name FROM {source}) n{skip}"
        )

    return f"""
        files AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, {o.lit(_FILE_RE2)}, 1))) AS name FROM {source}),
        firsts AS (SELECT id, name, 'OBJECT' AS type, 'FILE' AS subtype, 0.7 AS confidence FROM files
                   UNION ALL {family(1, True)} UNION ALL {family(2, True)} UNION ALL {family(3, False)} UNION ALL {family(4, False)} UNION ALL {family(5, False)}),
        entities AS (SELECT * FROM firsts UNION ALL
                     SELECT id, name, 'PERSON', CAST(NULL AS VARCHAR), 0.4 FROM (SELECT id, unnest(list_distinct(regexp_extract_all(text, {o.lit(plain(FAMILIES[6][1]))}))) AS name FROM {source}) p
                     WHERE contains(name, ' ') AND NOT EXISTS (SELECT 1 FROM firsts x WHERE x.id = p.id AND lower(x.name) = lower(p.name)))"""


@query("entity_extract", ["sentences"], f"WITH {_entities_sql('sentences')} SELECT id, name, type, subtype, confidence FROM entities")
def entity_extract(v: View) -> DataFrame:
    return extract_entities(spread(v("sentences"))).drop("pos")


@query(
    "entity_merge", ["sentences"],
    f"""WITH {_entities_sql('sentences')} SELECT lower(name) AS key, type, max(confidence) AS confidence, count(DISTINCT id) AS sources FROM entities GROUP BY lower(name), type""",
)
def entity_merge(v: View) -> DataFrame:
    entities, sources = merge_entities(extract_entities(spread(v("sentences"))))
    counted = sources.groupBy("key", "type").agg(F.count(F.lit(1)).alias("sources"))
    return entities.join(counted, ["key", "type"]).select("key", "type", "confidence", "sources")


def _clean_sql(x: str) -> str:
    p = f"trim({x}, ' \t\n.,;:')"
    for article in ("the ", "a ", "an "):
        p = f"(CASE WHEN lower(left({p}, {len(article)})) = '{article}' THEN substr({p}, {len(article) + 1}) ELSE {p} END)"
    return p


def _relations_sql(source: str, letters: str = r"\w./") -> str:
    parts = []
    phrase = PHRASE.replace(r"\w./", letters)
    for i, (verb, kind) in enumerate(VERB_TYPES.items()):
        pattern = o.lit("(?i)" + phrase + r"\s+" + verb + r"\s+" + phrase + r"(?:[\s,.;:]|$)")
        parts.append(
            f"SELECT id, '{kind}' AS type, {i} AS verb, unnest(regexp_extract_all(text, {pattern}, 1)) AS s, unnest(regexp_extract_all(text, {pattern}, 2)) AS t FROM {source}"
        )
    return f"""
        raw_rel AS ({' UNION ALL '.join(parts)}),
        clean_rel AS (SELECT id, type, verb, {_clean_sql('s')} AS source, {_clean_sql('t')} AS target FROM raw_rel),
        relations AS (SELECT id, source, target, type FROM (
            SELECT *, row_number() OVER (PARTITION BY id, lower(source), lower(target), type ORDER BY verb) AS rn FROM clean_rel
            WHERE source <> '' AND target <> '' AND lower(source) <> lower(target)) r WHERE rn = 1)"""


@query("relation_extract", ["sentences"], f"WITH {_relations_sql('sentences')} SELECT id, source, target, type, 0.6 AS confidence FROM relations")
def relation_extract(v: View) -> DataFrame:
    return extract_verb_relations(spread(v("sentences")))


# The given prose with two of its words exchanged for verbs. It has letters of four languages.
@query(
    "relation_extract_texts", ["linked_texts"],
    rf"""WITH {_relations_sql('linked_texts', r"_./\p{L}\p{M}\p{N}")} SELECT DISTINCT id, lower(source) AS source, lower(target) AS target, type FROM relations""",
)
def relation_extract_texts(v: View) -> DataFrame:
    found = extract_verb_relations(spread(v("linked_texts")))
    return found.select("id", F.lower("source").alias("source"), F.lower("target").alias("target"), "type")


# The four entities of these texts in order of discovery: file, function, identifier, person.
_COOCCUR = """WITH n AS (SELECT p_partkey AS id, ['lib/' || replace(p_name, ' ', '_') || '.rs', 'loadPart' || CAST(p_partkey AS VARCHAR), replace(p_name, ' ', '_'),
        'part_key_' || CAST(p_size AS VARCHAR), 'Mary Jones'] AS names FROM part),
    f AS (SELECT id, names[i] AS source, names[j] AS target FROM n, (SELECT unnest(range(1, 6)) AS i) a, (SELECT unnest(range(1, 6)) AS j) b WHERE i < j)
    SELECT id, source, target, 'RELATED_TO' AS type, 0.3 AS confidence FROM f"""


@query("cooccur", [], _COOCCUR)
def cooccur(v: View) -> DataFrame:
    return co_occurrence(spread(v("plain_sentences")))


@query(
    "relations_or_cooccur", ["sentences"],
    f"""WITH {_relations_sql('sentences')}, c AS ({_COOCCUR})
        SELECT id, source, target, type, 0.6 AS confidence FROM relations UNION ALL SELECT id + (SELECT count(*) FROM part), source, target, type, confidence FROM c""",
)
def relations_or_cooccur(v: View) -> DataFrame:
    parts = v("part").agg(F.count(F.lit(1)).alias("n")).scalar()
    plain = v("plain_sentences").withColumn("id", F.col("id") + parts)
    return extract_relations(spread(v("sentences").unionByName(plain)))


@query("session_counts", ["observations"], "SELECT session_id, count(*) AS observation_count FROM observations GROUP BY session_id")
def session_counts(v: View) -> DataFrame:
    return observation_counts(v("observations"))


@query(
    "session_lifecycle", ["hooks"],
    f"""SELECT session_id, min(ts) AS started_at, max(ts) AS last_event_at, min(ts) FILTER (WHERE hook_type = 'session_end') AS ended_at, count(*) AS events,
        CASE WHEN count(*) FILTER (WHERE hook_type = 'session_end') > 0 THEN 'completed' ELSE 'active' END AS status,
        count(*) FILTER (WHERE hook_type = 'session_end') = 0 AND min(ts) < TIMESTAMP '{NOW}' - INTERVAL '48' HOUR AS stuck FROM hooks GROUP BY session_id""",
)
def lifecycle(v: View) -> DataFrame:
    return session_lifecycle(v("hooks"), NOW)


_LEASES = """WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY ts, event_id) AS rn FROM lease_log),
    walk(action_id, rn, event_id, ts, holder, expires, granted) AS (
        SELECT action_id, rn, event_id, ts, holder_id, ts + INTERVAL '6' HOUR, true FROM ordered WHERE rn = 1
        UNION ALL
        SELECT x.action_id, x.rn, x.event_id, x.ts,
               CASE WHEN x.ts < w.expires AND w.holder <> x.holder_id THEN w.holder ELSE x.holder_id END,
               CASE WHEN x.ts < w.expires AND w.holder <> x.holder_id THEN w.expires ELSE x.ts + INTERVAL '6' HOUR END,
               NOT (x.ts < w.expires AND w.holder <> x.holder_id)
        FROM walk w JOIN ordered x ON x.action_id = w.action_id AND x.rn = w.rn + 1)"""


@query("lease_replay", ["lease_log"], f"{_LEASES} SELECT event_id, action_id, granted FROM walk")
def lease_replay(v: View) -> DataFrame:
    decisions, _ = replay_leases(v("lease_log"), 6 * 3600)
    return decisions.select("event_id", "action_id", "granted")


_LIVE_AT = "2024-01-20 00:00:00"


@query(
    "lease_live", ["lease_log"],
    f"""{_LEASES.replace('FROM lease_log)', f"FROM lease_log WHERE ts <= TIMESTAMP '{_LIVE_AT}')")}
        SELECT action_id, holder AS holder_id, expires AS expires_at FROM walk w
        WHERE rn = (SELECT max(rn) FROM ordered x WHERE x.action_id = w.action_id) AND expires > TIMESTAMP '{_LIVE_AT}'""",
)
def lease_live(v: View) -> DataFrame:
    _, live = replay_leases(v("lease_log"), 6 * 3600, _LIVE_AT)
    return live.select("action_id", "holder_id", "expires_at")
