"""The stored vector index against all pairs: pruning, ties, projects, odd vectors, changes, refused models."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import vector_index as vi

DOCS, QUERIES = "doc_id string, project string, embedding array<float>", "query_id long, project string, embedding array<float>"


def brute(queries, docs, k):
    out = {}
    for i, p, e in queries:
        hits = []
        for n, dp, v in docs:
            if v and p in ("", dp):
                a, b = np.asarray(e, np.float32).astype(float), np.asarray(v, np.float32).astype(float)
                na, nb = np.linalg.norm(a), np.linalg.norm(b)
                hits.append((-(round(float(a @ b / (na * nb)), 9) + 0.0) if na and nb else -0.0, n))
        out[i] = [(n, -s + 0.0) for s, n in sorted(hits)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def close(got, want):
    assert {q: [d for d, _ in hits] for q, hits in got.items()} == {q: [d for d, _ in hits] for q, hits in want.items() if hits}
    assert all(abs(s - t) < 2e-9 for q in got for (_, s), (_, t) in zip(got[q], want[q]))


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    tops = rnd.normal(size=(12, 8)) * 4
    docs = [(f"d{i:04d}", "p" if i % 3 else "q", (tops[i % 12] + rnd.normal(size=8) * 0.3).tolist()) for i in range(1500)]
    docs += [(f"t{i}", "q", docs[0][2]) for i in range(30)] + [("zero", "p", [0.0] * 8), ("none", "p", None), ("empty", "p", [])]
    queries = [(i, ("", "p", "q", "r")[i % 4], (tops[i % 12] + rnd.normal(size=8) * 0.2).tolist()) for i in range(40)] + [(98, "", [0.0] * 8), (99, None, docs[0][2])]
    return docs, queries


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "i")
    vi.write_vector_index(spark.createDataFrame(rows[0], DOCS), path, "local", 12)
    return path


def test_exact(spark, rows, stored):
    docs, queries = rows
    got = found(vi.search_stored_vectors(spark.createDataFrame(queries, QUERIES), stored, "local", 7))
    close(got, brute([(i, p or "", e) for i, p, e in queries], docs, 7))


def test_few_folders_are_read(spark, rows, stored):
    _, cells = vi.read_cells(spark, stored)
    queries = spark.createDataFrame([q for q in rows[1][:12] if q[1] == ""], QUERIES).withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = vi._visits(queries, cells, 8, 5, True)
    first = vi._search(near, stored, 5)
    bars = first.groupBy("query_id").agg(F.min("score").alias("bar"))
    more = vi._visits(queries.join(bars, "query_id"), cells, 8, 5, False)
    visited = near.count() + more.count()
    assert visited <= queries.count() * 4 < queries.count() * len(cells.rows)
    plan = vi.read_vectors(spark, stored, [1, 3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)


def test_second_model_or_size_is_refused(spark, rows, stored):
    queries = spark.createDataFrame(rows[1][:2], QUERIES)
    with pytest.raises(ValueError, match="model local"):
        vi.search_stored_vectors(queries, stored, "text-embedding-3-small")
    with pytest.raises(ValueError, match="model local"):
        vi.change_vector_index(spark, stored, "other", queries.selectExpr("'x' AS doc_id", "project", "embedding"))
    short = spark.createDataFrame([("x", "p", [1.0, 2.0])], DOCS)
    with pytest.raises(Exception, match="size 8 only"):
        vi.change_vector_index(spark, stored, "local", short)
    with pytest.raises(Exception, match="size 8 only"):
        vi.search_stored_vectors(short.selectExpr("1L AS query_id", "project", "embedding"), stored, "local").collect()
    mixed = spark.createDataFrame([("a", "", [1.0, 2.0]), ("b", "", [1.0])], DOCS)
    with pytest.raises(Exception, match="size 1 only"):
        vi.write_vector_index(mixed, stored + "-mixed", "local")


def test_changes(spark, rows, tmp_path):
    docs, queries = rows
    path = str(tmp_path / "i")
    vi.write_vector_index(spark.createDataFrame(docs, DOCS), path, "local", 12)
    rnd = random.Random(3)
    changed = [(f"d{i:04d}", "p", [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(0, 300, 7)] + [(f"n{i}", "q", docs[i][2]) for i in range(20)]
    deleted = [(f"d{i:04d}",) for i in range(5, 1500, 12)] + [("unknown",)]  # a whole cell
    vi.change_vector_index(spark, path, "local", spark.createDataFrame(changed, DOCS), spark.createDataFrame(deleted, "doc_id string"))
    after = {d: (d, p, e) for d, p, e in docs} | {d: (d, p, e) for d, p, e in changed}
    for (d,) in deleted:
        after.pop(d, None)
    got = found(vi.search_stored_vectors(spark.createDataFrame(queries, QUERIES), path, "local", 6))
    close(got, brute([(i, p or "", e) for i, p, e in queries], list(after.values()), 6))


def test_few_vectors(spark, tmp_path):
    queries = spark.createDataFrame([(1, "", [1.0, 0.0])], QUERIES)
    for n, docs in enumerate(([("a", "", [0.0, 0.0])], [("a", "", [1.0, 0.0]), ("b", "", [1.0, 0.0])])):
        vi.write_vector_index(spark.createDataFrame(docs, DOCS), str(tmp_path / str(n)), "m")
        assert [r.doc_id for r in vi.search_stored_vectors(queries, str(tmp_path / str(n)), "m").orderBy("rank").collect()] == [d[0] for d in docs]
