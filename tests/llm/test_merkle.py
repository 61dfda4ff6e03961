"""Merkle manifest: against plain recursion, its SQL, odd rows, and proofs that catch changes."""

import hashlib
import zlib

import oracle
import pytest

from memspark.llm import merkle
from memspark.llm.queries import ORACLE_SQL, QUERIES

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """[(digest, members)] up to one node; siblings are noted for every member."""
    beside = {m: [] for _, ms in nodes for m in ms}
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for j, (_, ms) in enumerate(run):
                for m in ms:
                    beside[m].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            up.append((h(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0][0], beside


def brute(rows):
    leaf = [h(*map(field, r)) for r in rows]
    groups, tops, paths = {}, [], {}
    for i, r in enumerate(rows):
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(i)
    for name in sorted(groups):
        members = sorted(groups[name], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        subroot, beside = climb([(leaf[i], [i]) for i in members])
        paths |= beside
        tops.append((subroot, members))
    root, beside = climb(tops)
    sub = {i: d for d, ms in tops for i in ms}
    out = []
    for i, r in enumerate(rows):
        path = paths[i] + beside[i]
        now = leaf[i]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            now = h(*map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
        for b, a in path:
            now = h(b, now, a)
        out.append((r[0], leaf[i], sub[i], root, h(*[x for p in path for x in p]), now, now == root))
    return out


def same(df, rows, height=3):
    got = [tuple(r[c] for c in NAMES) for r in merkle.digest(df, height).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    got = sorted(tuple(r[c] for c in NAMES) for r in QUERIES["op11_merkle"](spark, sf_dir).collect())
    assert got == sorted(brute(rows))
    assert {v for *_, v in got} == {True, False}
    want = oracle.connect(sf_dir).execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op11_merkle']})").fetchall()
    assert got == sorted(want)


def test_odd_rows(spark):
    rows = [(i * 7, "s", "one" if i % 3 else "two", i, f"Text {i}") for i in range(1300)]
    rows += [(5, "s", None, 1, None), (6, None, None, None, ""), (None, None, "", 3, "X"), (None, "a", "", 3, "X"), (9, "a", "é", 1, "É" * 100_000)]
    rows += [(11, "r", "one", 2, "same Row")] * 20
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS leaf", "1 AS tree", "2 AS at").repartition(7)
    same(df, rows)
    same(df, rows, 1)


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, count):
    rows = [(i, "s", "l", 1, "A") for i in range(count)]
    same(spark.createDataFrame(rows, DOCS), rows)


def test_many_groups(spark):
    rows = [(i, "s", f"l{i % 600}", 1, f"A{i}") for i in range(700)]
    same(spark.createDataFrame(rows, DOCS), rows)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.digest(df).columns == NAMES and merkle.digest(df).count() == 0
    assert merkle.manifest(df).count() == 0


def test_stored_manifest_catches_changes(spark):
    rows = [(i, "s", "ab"[i % 2], 1, f"Text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, DOCS)
    made = merkle.manifest(df)
    assert made.select("root").distinct().count() == 1
    assert {r.verified for r in merkle.verify(df, made).collect()} == {True}
    changed = df.selectExpr("doc_id", "source", "lang", "n_chars", "CASE WHEN doc_id = 17 THEN 'x' ELSE text END AS text").where("doc_id <> 30")
    assert sorted(r.doc_id for r in merkle.verify(changed, made).collect() if not r.verified) == [17, 30]
