"""Ranked retrieval for tables of queries: keyword, vector, graph, fused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memspark.functions.text import clip_snippet, query_terms
from memspark.operators.index import DOCUMENT, KeywordIndex, mean_length
from memspark.operators.ranking import top_per_group
from memspark.runtime import cut_lineage

SCORE_DIGITS = 9
BM25, VECTOR, GRAPH, HYBRID = "bm25", "vector", "graph", "hybrid"


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score) cut to the best ``limit`` per query, equal scores by document id."""
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], limit)


def bm25_idf(df: Column, total: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def bm25_search(queries: DataFrame, index: KeywordIndex, k1: float = 1.2, b: float = 0.75, limit: int = 10, scope: str = "global") -> DataFrame:
    """BM25 for every query. Counts are over all projects unless ``scope='project'``; a query's project filters documents.

    The wanted terms are a semi-join on the grouping key of the index rows, which Catalyst moves below the aggregation:
    only tokens some query asks for are shuffled, and one row per document, whose term is empty. Counts, lengths and
    scores read those same rows, which are written once.
    """
    terms = queries.select(
        "query_id", F.coalesce("project", F.lit("")).alias("q_project"), F.explode(query_terms(F.col("query"))).alias("term")
    )
    # The empty term rides along with each query, so that the wanted set is one expression over the queries.
    wanted = queries.select(F.explode(F.concat(query_terms(F.col("query")), F.array(F.lit(DOCUMENT)))).alias("term")).distinct()
    # Written, as Spark would read and cut the texts again for each use, whose filters differ.
    hits = cut_lineage(index.rows.join(wanted, "term", "left_semi"))
    by = ["project"] if scope == "project" else []
    # One row per term and document: counting rows with tf > 0 equals counting rows, and keeps tf in the shared plan.
    counts = hits.groupBy("term", *by).agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"), F.sum("doc_len").alias("length"))
    whole = counts.filter(F.coalesce(F.col("df"), F.lit(0)) > 0).groupBy(*by).agg(
        F.max(F.when(F.col("term") == DOCUMENT, F.col("df"))).alias("n"), F.max(F.when(F.col("term") == DOCUMENT, F.col("length"))).alias("total")
    )
    stats = whole.select(*by, "n", mean_length(F.col("total"), F.col("n")).alias("avgdl"))
    found = hits.filter(F.col("term") != DOCUMENT)  # the document rows have served once they are counted
    if by:
        weights = counts.join(stats, by).select("term", *by, bm25_idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
        weighted = found.join(weights, ["term", *by])
    else:
        weights = counts.select("term", bm25_idf(F.col("df"), stats.select("n").scalar()).alias("idf"))
        weighted = found.join(weights, "term").withColumn("avgdl", stats.select("avgdl").scalar())
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    scored = (
        weighted.withColumn("part", part)
        .join(terms, "term")
        .filter((F.col("q_project") == "") | (F.col("q_project") == F.col("project")))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )
    return ranked(scored, limit)


# Both sides of a scored tile are bounded: at most so many queries by so many documents.
QUERY_BLOCK, DOCUMENT_BLOCK = 512, 4096


def _packed(batches: Iterator[pd.DataFrame], salts: int, block: int) -> Iterator[pd.DataFrame]:
    """Document rows as blocks of one vector size, with the vectors as one array of doubles."""
    n = TaskContext.get().partitionId()
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            for start in range(0, len(part), block):
                rows = part.iloc[start : start + block]
                n += 1
                vectors = np.concatenate([np.asarray(x, np.float64) for x in rows["embedding"]])
                yield pd.DataFrame({"dim": [dim], "salt": [n % salts], "ids": [rows["doc_id"].to_list()], "projects": [rows["project"].to_list()], "packed": [vectors.tobytes()]})


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def _score_tiles(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best k documents of each tile for each of its queries, equal scores by document id; of a batch only one tile at a
    time is more than Arrow's own memory."""
    for batch in batches:
        for n in range(batch.num_rows):
            tile = {name: batch.column(name)[n] for name in ("ids", "projects", "packed", "queries")}
            ids, projects = np.array(tile["ids"].as_py(), dtype=object), np.array(tile["projects"].as_py(), dtype=object)
            docs = _unit(np.frombuffer(tile["packed"].as_buffer(), np.float64).reshape(len(ids), -1))
            asked = tile["queries"].values
            queries = _unit(asked.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1))
            asked = list(zip(asked.field("query_id").to_pylist(), asked.field("project").to_pylist(), strict=True))
            scores = np.round(queries @ docs.T, SCORE_DIGITS) + 0.0
            out_q, out_d, out_s = [], [], []
            for row, (query_id, project) in enumerate(asked):
                usable = np.arange(len(ids)) if project == "" else np.flatnonzero(projects == project)
                own = scores[row, usable]
                if len(own) > k:
                    usable = usable[own >= np.partition(own, len(own) - k)[len(own) - k]]
                best = sorted(usable.tolist(), key=lambda i: (-scores[row, i], ids[i]))[:k]
                out_q += [query_id] * len(best)
                out_d += [ids[i] for i in best]
                out_s += [scores[row, i] for i in best]
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((out_q, out_d, out_s), schema, strict=True)], schema=schema)


def score_tiles(tiles: DataFrame, limit: int, query_type: T.DataType, doc_type: T.DataType) -> DataFrame:
    """``tiles(ids, projects, packed, queries)`` -> (query_id, doc_id, score), at most ``limit`` rows for a query of a tile."""
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", doc_type), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    return tiles.mapInArrow(lambda it: _score_tiles(it, limit, arrow), schema)


def vector_search(
    query_vectors: DataFrame, vectors: DataFrame, limit: int = 10, query_block: int = QUERY_BLOCK, document_block: int = DOCUMENT_BLOCK
) -> DataFrame:
    """Exact cosine top-k. ``query_vectors(query_id, project, embedding)``, ``vectors(doc_id, project, embedding)``.

    Queries and documents are packed into blocks of one vector size; every block of queries meets every block of documents
    of that size in a task, and each tile gives at most ``limit`` rows per query, so no table of all pairs exists. Nothing
    passes through the driver; a query is compared with the vectors of its own size, whatever other sizes there are.
    """
    queries = query_vectors.select("query_id", F.coalesce("project", F.lit("")).alias("project"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.filter(F.size("embedding") > 0)
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(W.partitionBy("dim", "lane").orderBy("query_id"))
    # Lanes bound what is numbered together; each lane is cut into blocks.
    placed = queries.withColumns({"dim": F.size("embedding"), "lane": F.pmod(F.xxhash64("query_id"), F.lit(salts))}).withColumn("block", F.floor((place - 1) / query_block))
    blocks = placed.groupBy("dim", "lane", "block").agg(F.collect_list(F.struct("query_id", "project", "embedding")).alias("queries"))
    spread = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "queries")
    kind = dict(vectors.dtypes)["doc_id"]
    slim = vectors.select(F.size("embedding").alias("dim"), "doc_id", F.coalesce("project", F.lit("")).alias("project"), "embedding").filter("dim > 0")
    packed = slim.mapInPandas(lambda it: _packed(it, salts, document_block), f"dim int, salt int, ids array<{kind}>, projects array<string>, packed binary")
    tiles = packed.join(spread, ["dim", "salt"]).drop("salt", "dim")
    return ranked(score_tiles(tiles, limit, queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType), limit)


def rrf_fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, engine, doc_id, rank) rows."""
    k = k if k > 0 else 60
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), SCORE_DIGITS).alias("score"))


def diversity_cap(hits: DataFrame, groups: DataFrame, per_group: int = 3) -> DataFrame:
    """Keep the best ``per_group`` hits of each group and query; hits without a group are never capped."""
    named = hits.join(groups.select("doc_id", "group"), "doc_id", "left").withColumn("group", F.coalesce("group", F.lit("")))
    if per_group <= 0:
        return named
    # Ungrouped hits are ranked apart, each in a partition of its own.
    key = F.when(F.col("group") == "", F.concat(F.lit("\u0001"), F.col("doc_id").cast("string"))).otherwise(F.col("group"))
    best = top_per_group(named.withColumn("__g", key), ["query_id", "__g"], [F.desc("score"), F.asc("doc_id")], per_group, "__r")
    return best.drop("__g", "__r")


def hybrid_search(
    engines: dict[str, DataFrame],
    groups: DataFrame | None = None,
    mode: str = HYBRID,
    k: int = 60,
    per_group: int = 3,
    limit: int = 10,
) -> DataFrame:
    """Fuse engine results, each (query_id, doc_id, score, rank) with up to 30 rows per query.

    A single mode gives that engine's own ranking. Missing engines are left out.
    """
    if mode != HYBRID:
        return ranked(engines[mode].select("query_id", "doc_id", "score"), limit)
    if not engines:
        raise ValueError("no engine given")
    lists = None
    for name, hits in engines.items():
        part = hits.select("query_id", F.lit(name).alias("engine"), "doc_id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    fused = rrf_fuse(lists, k)
    if groups is not None and per_group > 0:
        fused = diversity_cap(fused, groups, per_group).drop("group")
    return ranked(fused, limit)


def hydrate(hits: DataFrame, observations: DataFrame, snippet: int = 200) -> DataFrame:
    """Add title, session, time, snippet and concepts; hits whose row is gone stay bare."""
    slim = observations.select(
        F.col("id").alias("doc_id"),
        "type",
        "title",
        "session_id",
        "created_at",
        clip_snippet(F.coalesce(F.nullif(F.col("narrative"), F.lit("")), F.nullif(F.col("tool_output"), F.lit(""))), snippet).alias("snippet"),
        "concepts",
    )
    return hits.join(slim, "doc_id", "left")
