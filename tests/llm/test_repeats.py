"""Repeated passages against brute force over all 50-byte strings."""

import hashlib
import random

import numpy as np

from memspark.llm import repeats as R


def brute(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            if i is not None and (s not in first or i < first[s]):
                first[s] = i
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            at = first.get(raw[k : k + 50])
            if at is not None and (i is None or at < i):
                gone[k : k + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(n=120):
    rng = random.Random(11)
    syllables = ["the ", "of ", "and ", "an", "er", "tion ", "é", "ß ", "中", "\n"]
    draw = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    shared = [draw(rng.choice([12, 18, 30, 60])) for _ in range(10)] + ["ab" * 60, "x" * 300, "the " * 40]
    rows = []
    for _ in range(n):
        text = draw(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            cut = rng.randint(0, len(part) // 3)
            text += part[cut:] + draw(rng.randint(0, 20))
        rows.append((rng.randint(0, 400), text))
    return rows + [(None, shared[3]), (None, shared[11]), (401, None), (402, ""), (403, "x" * 49), (404, "x" * 50), (0, rows[0][1]), (405, rows[1][1]), (406, draw(20000)), (407, draw(20000))]


def results(df):
    return sorted(map(tuple, R.remove_repeats(df).collect()), key=repr)


def test_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS row", "1 AS batch")
    assert results(df) == brute(rows)
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_small_batches_and_hot_anchors(spark, monkeypatch):
    for name, value in (("BATCH_BYTES", 1500), ("CHUNK_BYTES", 300), ("BUCKET_BYTES", 20000), ("HOT_BATCHES", 4)):
        monkeypatch.setattr(R, name, value)
    rows = made()
    assert results(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sort():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(97, 99, 3000, dtype=np.uint8), np.full(200, 97, np.uint8), np.tile(rng.integers(97, 123, 70, dtype=np.uint8), 9)])
    starts = rng.permutation(len(text) - 50)
    order, run = R.sort_suffixes(text, starts)
    raw = text.tobytes()
    strings = [raw[s : s + 50] for s in starts[order].tolist()]
    assert strings == sorted(strings)
    assert [strings[i] == strings[i - 1] for i in range(1, len(strings))] == [run[i] == run[i - 1] for i in range(1, len(strings))]


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
