"""Decontamination against brute force over all windows."""

import hashlib
import random
import re

from memspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=10):
    words = WORD.findall(fold(text))
    hit, names = set(), set()
    for name, item in items:
        of = WORD.findall(fold(item))
        size = min(window, len(of))
        if not size:
            continue
        windows = {tuple(of[i : i + size]) for i in range(len(of) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(map(tuple, D.leak_digest(df, bench).collect()), key=repr)
    assert got == sorted(((i, *brute(t, [(n or "", x) for n, x in items])) for i, t in docs), key=repr)


def test_random_words(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice("a b c É 中 x9".split()) for _ in range(n))
    items = [(str(i), draw(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(25)] + [("7", "a b a b a b"), ("dup", "a b a b a b"), (None, "zz Zz"), ("n", None)]
    docs = [(i % 90, draw(rng.randint(0, 60))) for i in range(100)] + [(None, "ZZ,zz!"), (5, None), (6, ""), (7, "-.-")]
    docs += [(200, items[3][1] + " stop " + items[3][1])]
    check(spark, docs, items)
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)  # several automata, one pass each
    check(spark, docs, items)


def test_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Kept before, {item.title()}; kept after.", "x"), (2, "clean text", None), (3, item, "gone"), (4, None, "y"), (1, "clean text", "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    out = sorted(map(tuple, D.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"), max_coverage=0.8).collect()), key=repr)
    assert out == sorted([(1, "Kept before, ; kept after.", "x"), (2, "clean text", None), (4, None, "y"), (1, "clean text", "again")], key=repr)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(df, empty).count() == 5
    assert D.decontaminate(df.limit(0), empty).count() == 0
