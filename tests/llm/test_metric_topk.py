"""Top-k by tree against all inner products."""

import math

import numpy as np

from memspark.llm import metric_topk as T


def brute(rows, asked, k):
    used = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in used:
        if asked(i):
            queries[i] = min(queries.get(i, v), v, key=lambda v: np.array(v, np.int64).tobytes())
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in used if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, asked, k=10):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return sorted(map(tuple, T.top_k(df, df.where(asked), k).collect()))


def test_random_ties_and_odd_rows(spark, monkeypatch):
    for name, value in (("PAGE_ROWS", 60), ("LEAF_ROWS", 5), ("FANOUT", 3)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(300)]  # a third of all rows alike
    rows += [(i, (np.round(rng.normal(0, 1, 6)) / 4).tolist()) for i in range(700, 760)]
    rows += [(900, None), (None, [1.0] * 6), (901, []), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    rows += [(910, [0.1, 0.2]), (920, [0.3, 0.4]), (920, [0.3, 0.4]), (10, [0.5] * 6), (930, [-3.0] * 6), (940, [0.0] * 6)]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0, 10)
    assert run(spark, rows, "vec_id % 50 = 0", 3) == brute(rows, lambda i: i % 50 == 0, 3)


def test_table_and_empty(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, T.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == brute(rows, lambda i: i % 100 == 0, 10)
    assert T.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_leaves_nodes_out():
    rng = np.random.default_rng(3)
    vectors = (rng.normal(0, 40, (3000, 3)) + rng.choice([-900, 0, 900], (3000, 3))).astype(np.int64)
    space = T.Space(int((vectors**2).sum(1).max()))
    page, seen = T.Page(np.arange(3000), vectors, space), []
    plain = space.dots
    space.dots = lambda a, b: seen.append(len(a) * (b.shape[1] if b.ndim == 2 else 1)) or plain(a, b)
    own = np.array([-1, 7, 8])
    scores, ids = page.search(own, vectors[[5, 7, 8]], 5, np.full(3, np.inf))
    for k, at in enumerate((5, 7, 8)):
        want = sorted(((int(s), i) for i, s in enumerate(vectors @ vectors[at]) if i != own[k]), key=lambda x: (-x[0], x[1]))[:5]
        assert list(zip(scores[k].tolist(), ids[k].tolist())) == want
    page.space, seen[:] = space, []
    page.search(own[:1], vectors[[5]], 5, np.full(1, np.inf))
    assert sum(seen) < 1500


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.choice([-1, 1], 64) * rng.uniform(290_000, 300_000, 64)).tolist()) for i in range(60)] + [(60 + i, rng.normal(0, 1, 64).tolist()) for i in range(20)]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0, 10)
    beyond = [(i, [1e300 * (1 if i % 2 else -1)] * 3) for i in range(20)]
    assert len(run(spark, beyond, "vec_id = 0")) == 10
