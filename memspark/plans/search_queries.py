"""Queries on indexes, retrieval and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from memspark.functions.text import highlight_terms, index_text, query_terms
from memspark.functions.vectors import hash_embedding, hash_embedding_sparse
from memspark.operators.graph import bfs, graph_search, match_entities, neighbours
from memspark.operators.index import build_keyword_index, corpus_stats, delete_documents, read_for_queries, term_frequencies, upsert_keyword_index, write_keyword_index
from memspark.operators.search import bm25_search, diversity_cap, hybrid_search, hydrate, rrf_fuse, vector_search
from memspark.operators.vector_index import change_vector_index, search_stored_vectors, write_vector_index
from memspark.plans import oracle_text as o
from memspark.plans.registry import View, query
from memspark.runtime import ensure_checkpoint_dir
from memspark.sources.tables import spread
from memspark.streaming.index import current_index, merge_segments, write_segment

STAGE = 30
STORED_BUCKETS = 16
HITS = ("query_id", "doc_id", "score", "rank")


def _index_text():
    """All searchable parts of an observation; the view has no subtitles."""
    return index_text(F.col("title"), F.lit(""), F.col("narrative"), F.col("concepts"), F.col("files"), F.col("facts"))


def documents_index(v: View):
    return build_keyword_index(spread(v("documents")), project_col=None)


def observations_index(v: View):
    return build_keyword_index(v("observations").select(F.col("id").alias("doc_id"), "project", _index_text().alias("text")))


@query("tokenize_postings", [], f"WITH {o.postings('documents')} SELECT doc_id, term, tf FROM postings")
def tokenize_postings(v: View) -> DataFrame:
    return documents_index(v).postings.select("doc_id", "term", "tf")


@query("corpus_stats", [], f"WITH {o.postings('documents')} SELECT count(*) AS total_docs, round(avg(n), 6) AS avg_doc_len FROM doc_len")
def stats(v: View) -> DataFrame:
    return corpus_stats(documents_index(v)).select("total_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query("document_frequency", [], f"WITH {o.postings('documents')} SELECT term, count(*) AS df FROM postings GROUP BY term")
def document_frequency(v: View) -> DataFrame:
    return term_frequencies(documents_index(v))


@query("bm25_topk", ["queries"], f"WITH {o.bm25('queries', 'documents', 10)} SELECT query_id, doc_id, score, rank FROM bm25_hits")
def bm25_topk(v: View) -> DataFrame:
    return bm25_search(v("queries"), documents_index(v)).select(*HITS)


def stored_index(v: View) -> str:
    """The documents' index as a stored one."""
    docs = documents_index(v)
    path = f"{ensure_checkpoint_dir(docs.rows.sparkSession)}/memspark-index-{uuid.uuid4().hex}"
    write_keyword_index(docs, path, STORED_BUCKETS)
    return path


@query("bm25_stored_topk", ["queries"], f"WITH {o.bm25('queries', 'documents', 10)} SELECT query_id, doc_id, score, rank FROM bm25_hits")
def bm25_stored_topk(v: View) -> DataFrame:
    return bm25_search(v("queries"), read_for_queries(v("queries"), stored_index(v), STORED_BUCKETS)).select(*HITS)


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' replaced text of ' || lang ELSE text END AS text FROM documents)"
_KEPT = "(SELECT * FROM documents WHERE lang <> 'fr')"


@query("index_upsert", [], f"WITH {o.postings(_CHANGED)} SELECT doc_id, term, tf FROM postings")
def index_upsert(v: View) -> DataFrame:
    """Every third document gets another text."""
    text = F.concat("source", F.lit(" replaced text of "), "lang").alias("text")
    changed = build_keyword_index(v("documents").filter("doc_id % 3 = 0").select("doc_id", text), project_col=None)
    return upsert_keyword_index(documents_index(v), changed).postings.select("doc_id", "term", "tf")


@query("index_delete", [], f"WITH {o.postings(_KEPT)} SELECT doc_id, term, tf FROM postings")
def index_delete(v: View) -> DataFrame:
    gone = v("documents").filter("lang = 'fr'").select("doc_id")
    return delete_documents(documents_index(v), gone).postings.select("doc_id", "term", "tf")


_STREAMED = """(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' replaced text of ' || lang ELSE text END AS text FROM documents WHERE lang <> 'fr')"""


@query("index_stream_state", [], f"WITH {o.postings(_STREAMED)} SELECT doc_id, term, tf FROM postings")
def index_stream_state(v: View) -> DataFrame:
    """Five batches: all documents by halves, new texts, deletions, and the first half once more; merged before and after."""
    docs = v("documents")
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/memspark-stream-{uuid.uuid4().hex}"
    at = lambda hour: F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp").alias("ts")
    row = lambda rows, text, hour, deleted=False: rows.select("doc_id", F.lit("").alias("project"), text.alias("text"), at(hour), F.lit(deleted).alias("deleted"))
    first = row(docs.filter("doc_id % 2 = 0"), F.col("text"), 1)
    batches = [
        first, row(docs.filter("doc_id % 2 = 1"), F.col("text"), 2), row(docs.filter("doc_id % 3 = 0"), F.concat("source", F.lit(" replaced text of "), "lang"), 3),
        row(docs.filter("lang = 'fr'"), F.lit(None).cast("string"), 4, True),
    ]
    for number, batch in enumerate(batches):
        write_segment(batch, f"run-{number:012d}", path)
    merge_segments(spark, path, 2)
    write_segment(first, "run-000000000000", path)
    merge_segments(spark, path, 2)
    return current_index(spark, path).postings.select("doc_id", "term", "tf")


@query(
    "bm25_project_topk", ["project_queries", "observations"],
    f"WITH {o.bm25('project_queries', 'observations', 10, 'id', 'project', o.INDEX_TEXT)} SELECT query_id, doc_id, score, rank FROM bm25_hits",
)
def bm25_project_topk(v: View) -> DataFrame:
    return bm25_search(v("project_queries"), observations_index(v)).select(*HITS)


_TAGGED = "(SELECT query_id, project, query || ' auth db endpoint functions' AS query FROM queries)"


@query("synonym_expand", ["queries"], f"WITH {o.query_terms(_TAGGED)} SELECT query_id, term FROM q_terms")
def synonym_expand(v: View) -> DataFrame:
    text = F.concat("query", F.lit(" auth db endpoint functions"))
    return v("queries").select("query_id", F.explode(query_terms(text)).alias("term"))


@query("highlight_terms", ["queries"], f"WITH {o.query_terms('queries')} SELECT query_id, term FROM q_base")
def highlights(v: View) -> DataFrame:
    return v("queries").select("query_id", F.explode(highlight_terms(F.col("query"))).alias("term"))


@query("vector_topk", ["query_vectors", "vectors"], f"WITH {o.vector('query_vectors', 'vectors', 10)} SELECT query_id, doc_id, score, rank FROM vector_hits")
def vector_topk(v: View) -> DataFrame:
    return vector_search(v("query_vectors"), v("vectors")).select(*HITS)


def stored_vectors(v: View) -> str:
    vectors = v("vectors")
    path = f"{ensure_checkpoint_dir(vectors.sparkSession)}/memspark-vectors-{uuid.uuid4().hex}"
    write_vector_index(vectors, path, "local")
    return path


@query("vector_stored_topk", ["query_vectors", "vectors"], f"WITH {o.vector('query_vectors', 'vectors', 10)} SELECT query_id, doc_id, score, rank FROM vector_hits")
def vector_stored_topk(v: View) -> DataFrame:
    return search_stored_vectors(v("query_vectors"), stored_vectors(v), "local").select(*HITS)


_MOVED = """(SELECT doc_id, project, CASE WHEN doc_id LIKE '%3' THEN [-x for x in embedding] ELSE embedding END AS embedding
             FROM vectors WHERE doc_id NOT LIKE '%7')"""


@query("vector_index_change", ["query_vectors", "vectors"], f"WITH {o.vector('query_vectors', _MOVED, 10)} SELECT query_id, doc_id, score, rank FROM vector_hits")
def vector_index_change(v: View) -> DataFrame:
    """Ids that end in 3 get the opposite vector, those that end in 7 go."""
    path, vectors = stored_vectors(v), v("vectors")
    moved = vectors.filter("doc_id LIKE '%3'").withColumn("embedding", F.transform("embedding", lambda x: -x))
    change_vector_index(vectors.sparkSession, path, "local", moved, vectors.filter("doc_id LIKE '%7'").select("doc_id"))
    return search_stored_vectors(v("query_vectors"), path, "local").select(*HITS)


_SIZES = "SELECT {id}, '' AS project, list_slice(embedding, 1, len(embedding) - CAST(vec_id % 3 AS INTEGER)) AS embedding FROM embeddings"


@query(
    "vector_mixed_sizes", [],
    f"""WITH mq AS ({_SIZES.format(id="vec_id AS query_id")} WHERE vec_id % 5 = 0), mv AS ({_SIZES.format(id="vec_id AS doc_id")}),
        s AS (SELECT query_id, doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
              FROM mq q JOIN mv v ON len(q.embedding) = len(v.embedding))
        SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) r WHERE rank <= 5""",
)
def vector_mixed_sizes(v: View) -> DataFrame:
    """Whole vectors beside some that lack one or two numbers."""
    sizes = v("embeddings").select("vec_id", F.lit("").alias("project"), F.slice("embedding", F.lit(1), (F.size("embedding") - F.col("vec_id") % 3).cast("int")).alias("embedding"))
    return vector_search(sizes.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), sizes.withColumnRenamed("vec_id", "doc_id"), 5).select(*HITS)


@query("graph_match", ["queries", "g_entities"], f"WITH {o.seeds('queries')} SELECT query_id, entity_id, confidence, rank FROM seeds")
def graph_match(v: View) -> DataFrame:
    return match_entities(v("queries"), v("g_entities")).select("query_id", "entity_id", "confidence", "rank")


@query(
    "graph_bfs", ["queries", "g_entities", "g_edges"], f"WITH {o.seeds('queries')}, {o.bfs()} SELECT query_id, node, depth FROM reached"
)
def graph_bfs(v: View) -> DataFrame:
    return bfs(match_entities(v("queries"), v("g_entities")), v("g_edges"))


@query(
    "graph_topk", ["queries", "g_entities", "g_edges", "g_links"],
    f"WITH {o.seeds('queries')}, {o.bfs()}, {o.graph(10)} SELECT query_id, doc_id, score, rank FROM graph_hits",
)
def graph_topk(v: View) -> DataFrame:
    return graph_search(v("queries"), v("g_entities"), v("g_edges"), v("g_links")).select(*HITS)


@query(
    "graph_neighbours", ["g_entities", "g_edges"],
    """WITH names AS (SELECT DISTINCT 'r' || CAST(r_regionkey AS STRING) AS query_id, 'ring ' || CAST(r_regionkey + 1 AS STRING) AS name FROM region),
       starts AS (SELECT n.query_id, e.id FROM names n JOIN g_entities e ON contains(lower(e.name), lower(n.name))),
       pairs AS (SELECT source_id AS a, target_id AS b FROM g_edges UNION SELECT target_id, source_id FROM g_edges),
       one AS (SELECT DISTINCT query_id, id, b AS node FROM starts JOIN pairs ON a = id),
       two AS (SELECT DISTINCT query_id, one.id, b AS node FROM one JOIN pairs ON a = node),
       near AS (SELECT DISTINCT query_id, node FROM (SELECT * FROM one UNION SELECT * FROM two) x WHERE node <> id)
       SELECT query_id, e.id, e.name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS rank FROM near) r
       JOIN g_entities e ON e.id = r.node WHERE rank <= 25""",
)
def graph_neighbours(v: View) -> DataFrame:
    key = F.col("r_regionkey")
    names = v("region").select(
        F.concat(F.lit("r"), key.cast("string")).alias("query_id"), F.lit("").alias("project"), F.concat(F.lit("ring "), (key + 1).cast("string")).alias("name")
    ).distinct()
    return neighbours(names, v("g_entities"), v("g_edges")).select("query_id", "id", "name", "rank")


def engines(v: View) -> dict[str, DataFrame]:
    return {
        "bm25": bm25_search(v("queries"), observations_index(v), limit=STAGE),
        "vector": vector_search(v("query_vectors"), v("vectors"), limit=STAGE),
        "graph": graph_search(v("queries"), v("g_entities"), v("g_edges"), v("g_links"), limit=STAGE),
    }


def sessions_of(v: View) -> DataFrame:
    return v("observations").select(F.col("id").alias("doc_id"), F.col("session_id").alias("group"))


_ENGINE_VIEWS = ["queries", "query_vectors", "observations", "vectors", "g_entities", "g_edges", "g_links"]
_ENGINES = (
    o.bm25("queries", "observations", STAGE, "id", "project", o.INDEX_TEXT) + "," + o.vector("query_vectors", "vectors", STAGE) + ","
    + o.seeds("queries") + "," + o.bfs() + "," + o.graph(STAGE)
)
_FUSED = """
    fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
        SELECT query_id, doc_id, rank FROM bm25_hits UNION ALL SELECT query_id, doc_id, rank FROM vector_hits UNION ALL SELECT query_id, doc_id, rank FROM graph_hits) u
        GROUP BY query_id, doc_id)"""
_CAPPED = """
    grouped AS (SELECT f.*, coalesce(s.session_id, '') AS grp FROM fused f LEFT JOIN observations s ON s.id = f.doc_id),
    capped AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, doc_id) AS g FROM grouped) c WHERE g <= 3 OR grp = ''),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM capped) t WHERE rank <= 10)"""


@query("rrf_fuse", _ENGINE_VIEWS, f"WITH {_ENGINES}, {_FUSED} SELECT query_id, doc_id, score FROM fused")
def rrf(v: View) -> DataFrame:
    lists = None
    for hits in engines(v).values():
        part = hits.select("query_id", "doc_id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return rrf_fuse(lists)


@query(
    "diversity_cap", ["query_vectors", "vectors", "observations"],
    f"""WITH {o.vector('query_vectors', 'vectors', STAGE)},
        grouped AS (SELECT h.*, coalesce(s.session_id, '') AS grp FROM vector_hits h LEFT JOIN observations s ON s.id = h.doc_id)
        SELECT query_id, doc_id, score, grp FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, doc_id) AS g FROM grouped) c WHERE g <= 3 OR grp = ''""",
)
def diversity(v: View) -> DataFrame:
    hits = vector_search(v("query_vectors"), v("vectors"), limit=STAGE)
    return diversity_cap(hits.drop("rank"), sessions_of(v)).select("query_id", "doc_id", "score", F.col("group").alias("grp"))


@query("hybrid_search", _ENGINE_VIEWS, f"WITH {_ENGINES}, {_FUSED}, {_CAPPED} SELECT query_id, doc_id, score, rank FROM top")
def hybrid(v: View) -> DataFrame:
    return hybrid_search(engines(v), sessions_of(v)).select(*HITS)


_SNIPPET = r"""CASE WHEN length(narrative) <= 200 THEN narrative
    WHEN length(regexp_extract(left(narrative, 200), '(?s)^(.*)[ \t\n]', 1)) > 100 THEN regexp_extract(left(narrative, 200), '(?s)^(.*)[ \t\n]', 1) || '…'
    ELSE left(narrative, 200) || '…' END"""


@query(
    "smart_search", _ENGINE_VIEWS,
    f"""WITH {_ENGINES}, {_FUSED}, {_CAPPED} SELECT query_id, doc_id, score, rank, title, session_id, {_SNIPPET} AS snippet, array_to_string(concepts, ',') AS concepts
        FROM top LEFT JOIN observations o ON o.id = doc_id""",
)
def smart_search(v: View) -> DataFrame:
    hits = hybrid_search(engines(v), sessions_of(v))
    return hydrate(hits, v("observations")).select(
        *HITS, "title", "session_id", "snippet", F.array_join("concepts", ",").alias("concepts")
    )


@query("hash_embed")
def hash_embed(v: View) -> DataFrame:
    return spread(v("documents").select("doc_id", "text")).select("doc_id", hash_embedding(384)("text").alias("embedding"))


@query(
    "hash_embed_sql", [],
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
       s AS (SELECT doc_id, CAST(CAST('0x' || left(sha256(word), 8) AS BIGINT) % 384 AS INTEGER) AS slot,
                    CASE WHEN CAST('0x' || substr(sha256(word), 9, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w),
       c AS (SELECT doc_id, slot, CAST(sum(sign) AS DOUBLE) AS raw FROM s GROUP BY doc_id, slot HAVING sum(sign) <> 0)
       SELECT doc_id, slot, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""",
)
def hash_embed_sql(v: View) -> DataFrame:
    return hash_embedding_sparse(spread(v("documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "slot", F.round("weight", 9).alias("weight"))
