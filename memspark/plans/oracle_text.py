"""SQL spellings of the text functions, for the oracle only."""

from __future__ import annotations

from memspark.functions.privacy import ANSI_ESCAPE, EXACT_HINTS, FOLDED_HINTS, PRIVATE_BLOCK, REDACTED, SECRET_PATTERNS
from memspark.functions.text import STOPWORDS, SYNONYMS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(text: str) -> str:
    stop = ", ".join(lit(w) for w in STOPWORDS)
    spaced = (
        f"regexp_replace(lower(translate({text}, 'İΣ', 'iσ')), "
        r"'([\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}])', ' \1 ', 'g')"
    )
    return f"list_filter(regexp_extract_all({spaced}, '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 2 AND w NOT IN ({stop}))"


def stem(w: str) -> str:
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return (
        f"CASE WHEN ends_with({w}, 'ies') AND strlen({w}) > 4 THEN {cut(3)} || 'y' "
        f"WHEN ends_with({w}, 'sses') AND strlen({w}) > 5 THEN {cut(2)} "
        f"WHEN ends_with({w}, 'ing') AND strlen({w}) > 5 THEN {cut(3)} "
        f"WHEN ends_with({w}, 'ed') AND strlen({w}) > 4 THEN {cut(2)} "
        f"WHEN ends_with({w}, 'es') AND strlen({w}) > 3 THEN {cut(1)} "
        f"WHEN ends_with({w}, 's') AND strlen({w}) > 3 AND NOT ends_with({w}, 'ss') THEN {cut(1)} ELSE {w} END"
    )


#: An observation's searchable text.
INDEX_TEXT = (
    "concat_ws(' ', title, narrative, array_to_string(concepts, ' '), array_to_string(files, ' '), array_to_string(facts, ' '))"
)


def postings(docs: str, doc_id: str = "doc_id", project: str = "''", text: str = "text") -> str:
    """CTEs doc_words, doc_len and postings."""
    return f"""
        doc_words AS (SELECT {doc_id} AS doc_id, {project} AS project, {words(text)} AS ws FROM {docs}),
        doc_len AS (SELECT doc_id, project, len(ws) AS n FROM doc_words),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {stem('w')} AS term FROM (SELECT doc_id, unnest(ws) AS w FROM doc_words) u) s GROUP BY doc_id, term)"""


def synonym_rows() -> str:
    rows = ", ".join(f"({lit(k)}, {lit(v)})" for k, vs in SYNONYMS.items() for v in vs)
    return f"synonyms(term, other) AS (VALUES {rows})"


def query_terms(queries: str, text: str = "query") -> str:
    """CTEs synonyms, q_base and q_terms (query_id, project, term), each term once."""
    return f"""
        {synonym_rows()},
        q_base AS (SELECT DISTINCT query_id, project, {stem('w')} AS term FROM (SELECT query_id, project, unnest({words(text)}) AS w FROM {queries}) u),
        q_terms AS (SELECT query_id, project, term FROM q_base UNION SELECT query_id, project, other FROM q_base JOIN synonyms USING (term))"""


def bm25(queries: str, docs: str, limit: int, doc_id: str = "doc_id", project: str = "''", text: str = "text", name: str = "bm25_hits") -> str:
    return f"""
        {postings(docs, doc_id, project, text)},
        {query_terms(queries)},
        corpus AS (SELECT count(*) AS n, avg(n) AS avgdl FROM doc_len),
        idf AS (SELECT term, ln(((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings GROUP BY term),
        bm25_scored AS (
            SELECT q.query_id, p.doc_id, round(sum(i.idf * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * d.n / (SELECT avgdl FROM corpus)))), 9) AS score
            FROM q_terms q JOIN postings p USING (term) JOIN idf i USING (term) JOIN doc_len d ON d.doc_id = p.doc_id
            WHERE q.project = '' OR q.project = d.project
            GROUP BY q.query_id, p.doc_id),
        {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_scored) r WHERE rank <= {limit})"""


def vector(query_vectors: str, vectors: str, limit: int, name: str = "vector_hits") -> str:
    return f"""
        {name} AS (SELECT * FROM (
            SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM (SELECT q.query_id, v.doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
                  FROM {query_vectors} q, {vectors} v WHERE q.project = '' OR q.project = v.project) s) r
            WHERE rank <= {limit})"""


def seeds(queries: str, entities: str = "g_entities", limit: int = 32) -> str:
    return f"""
        g_tok AS (SELECT DISTINCT query_id, project AS qp, {stem('w')} AS tok FROM (SELECT query_id, project, unnest({words('query')}) AS w FROM {queries}) u),
        seeds AS (SELECT query_id, entity_id, confidence, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, entity_id) AS rank
            FROM (SELECT DISTINCT query_id, e.id AS entity_id, e.confidence FROM g_tok JOIN {entities} e ON contains(lower(e.name), tok) WHERE qp = '' OR qp = e.project) m) r
            WHERE rank <= {limit})"""


def bfs(min_confidence: float = 0.3, edges: str = "g_edges") -> str:
    return f"""
        pairs AS (SELECT source_id AS a, target_id AS b FROM {edges} WHERE confidence >= {min_confidence} UNION SELECT target_id, source_id FROM {edges} WHERE confidence >= {min_confidence}),
        hop1 AS (SELECT DISTINCT query_id, b AS node FROM seeds JOIN pairs ON a = entity_id),
        hop2 AS (SELECT DISTINCT query_id, b AS node FROM hop1 JOIN pairs ON a = node),
        reached AS (SELECT query_id, node, CAST(min(depth) AS INTEGER) AS depth FROM (
            SELECT query_id, entity_id AS node, 0 AS depth FROM seeds UNION ALL SELECT query_id, node, 1 FROM hop1 UNION ALL SELECT query_id, node, 2 FROM hop2) x
            GROUP BY query_id, node)"""


def graph(limit: int, links: str = "g_links", name: str = "graph_hits") -> str:
    return f"""
        {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT r.query_id, l.observation_id AS doc_id, round(sum(CASE WHEN coalesce(s.confidence, 0) = 0 THEN 0.5 ELSE s.confidence END / (1 + r.depth)), 9) AS score
            FROM reached r JOIN {links} l ON l.entity_id = r.node LEFT JOIN seeds s ON s.query_id = r.query_id AND s.entity_id = r.node
            GROUP BY r.query_id, l.observation_id) g) k WHERE rank <= {limit})"""


def redaction(source: str, key: str, text: str) -> str:
    """CTEs r0 .. rN and redacted(key, out, h0 .. hN)."""
    hint = " OR ".join([f"contains(t, {lit(h)})" for h in EXACT_HINTS] + [f"contains(lower(t), {lit(h)})" for h in FOLDED_HINTS])
    parts = [
        f"r00 AS (SELECT {key} AS k, regexp_replace({text}, {lit(PRIVATE_BLOCK)}, '', 'g') AS t FROM {source})",
        f"r0 AS (SELECT k, t, ({hint}) AS hint FROM r00)",
    ]
    for i, (_, pattern) in enumerate(SECRET_PATTERNS):
        hits = "".join(f", h{j}" for j in range(i))
        parts.append(
            f"r{i + 1} AS (SELECT k, hint, CASE WHEN hint THEN regexp_replace(t, {lit(pattern)}, {lit(REDACTED)}, 'g') ELSE t END AS t{hits}, "
            f"hint AND regexp_matches(t, {lit(pattern)}) AS h{i} FROM r{i})"
        )
    n = len(SECRET_PATTERNS)
    hits = "".join(f", h{j}" for j in range(n))
    parts.append(f"redacted AS (SELECT k, regexp_replace(t, {lit(ANSI_ESCAPE)}, '', 'g') AS out{hits} FROM r{n})")
    return ",\n".join(parts)


def hit_names() -> str:
    cells = ", ".join(f"CASE WHEN h{i} THEN {lit(name)} END" for i, (name, _) in enumerate(SECRET_PATTERNS))
    return f"array_to_string(list_filter([{cells}], lambda x: x IS NOT NULL), ',')"
