"""Near duplicates against all pairs of full sets."""

import random

import numpy as np

from memspark.llm import near_dedup as N
from memspark.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    least = {i: i for i in sets if i is not None}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(least)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(s and u and 100 * len(s & u) >= percent * len(s | u) for s in sets[a] for u in sets[b]):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    counts = [len(s) for s in (sets[i].pop(0) for i, _ in rows)]
    return sorted(((i, n, None if i is None else find(i), i is None or find(i) == i) for (i, _), n in zip(rows, counts)), key=repr)


def made(n=160, seed=5):
    """Groups of edited copies around the threshold, ladders of edits, exact copies and odd rows."""
    rng = random.Random(seed)
    draw = lambda k: [f"w{rng.randint(0, 4000)}" for _ in range(k)]
    rows, at = [], 10
    for _ in range(12):
        base = draw(rng.choice([5, 8, 40, 120, 300]))
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 4000)}"
            if rng.random() < 0.3:
                base = copy  # a ladder
            rows.append((at, rng.choice([" ", "\n", " \t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n "), (4, "only four words here"), (5, "Only FOUR words here"), (None, "only four words here"), (6, "É é"), (7, "é é"), (900, rows[0][1]), (900, rows[0][1]), (901, "long " * 9000), (902, "long " * 8000)]


def test_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS bands")
    got = sorted(map(tuple, N.near_groups(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute(rows)
    assert N.near_groups(df.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    rows = made(120, 9)
    got = sorted(map(tuple, N.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_estimate():
    rng = np.random.default_rng(1)
    for overlap in (0.3, 0.75, 0.9):
        a, b = [], []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
            joint = int(2 * 300 * overlap / (1 + overlap))
            a.append(pool[:300])
            b.append(np.concatenate([pool[:joint], pool[300 : 600 - joint]]))
        size = np.full(60, 300.0)
        got = N.estimate(N.registers(a), N.registers(b), size, size)
        assert abs(got.mean() - overlap) < 0.03 and abs(got - overlap).max() < N.SLACK
    merged = np.maximum(N.registers([a[0]]), N.registers([b[0]]))
    assert (merged == N.registers([np.union1d(a[0], b[0])])).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
