"""Fill-in-the-middle: against plain string handling, exact round trips, odd rows."""

import hashlib
import re

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm import fill_middle as fm
from memspark.llm.queries import ORACLE_SQL, QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, key):
    w = UNIT.findall(text)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(text, key):
    n, form, cuts, table = fm.transform(text.encode(), str(key))
    raw = text.encode()
    chars = (len(raw[: cuts[0]].decode()), len(raw[cuts[0] : cuts[1]].decode())) if cuts else (None, None)
    assert (n, form, *chars, table.bytes().decode()) == brute(text, key)
    assert fm.restored(table.bytes(), form).bytes() == raw


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x1c aé中😀<SPM>", max_size=40), st.integers(-5, 10**12))
def test_any_text(text, key):
    same(text, key)


def test_chunks(monkeypatch):
    text = " ab  cé\n" * 50 + "end "
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fm, "CHUNK", chunk)
        for key in range(40):
            same(text, key)


def test_marks_split_over_parts():
    for text in ("<S <P x> <", "a <S> b", "<< <M", "<P >"):
        for key in range(60):
            same(text, key)


def test_sql_and_brute_force(spark, sf_dir):
    con = oracle.connect(sf_dir)
    got = {r.doc_id: r for r in QUERIES["op13_fill_middle"](spark, sf_dir).collect()}
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op13_fill_middle']})").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in got.values()) == sorted(want)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, form, p, m, out = brute(r.text or "", r.doc_id)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(None, "a b c", 1), (7, None, 2), (8, "", 3), (3, "x y z", 4), (3, "x y z", 4), (9, "<M> in text", 5), (10, "  \n ", 6), (11, "w " * 300_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form int").withColumnRenamed("form", "output")
    out = fm.fill_in_middle(df.selectExpr("*", "doc_id AS form"))
    assert out.columns == ["doc_id", "text", "output", "form"]
    back = fm.undo(out.withColumnRenamed("text", "old")).collect()
    assert len(back) == len(rows) and all(r.text == r.old for r in back)
    digests = fm.digest(df).collect()
    assert len(digests) == len(rows) and sum(r.doc_id is None for r in digests) == 1
    assert fm.digest(df.limit(0)).count() == 0 and fm.fill_in_middle(df.limit(0)).count() == 0
    for r in digests:
        if r.doc_id == 9:
            assert r.form == "plain"


@pytest.mark.parametrize("places", [(0, 0), (0, 5), (2, 3), (5, 5)])
def test_cut(places):
    table = fm.PieceTable.of(b"abcde").cut(*places)
    assert [bytes(x) for x in table.stream()] == [b"abcde"[: places[0]], b"abcde"[places[0] : places[1]], b"abcde"[places[1] :]]
    assert [bytes(x) for x in table.cut(1).stream()][0] in (b"", b"a")
    assert table.cut(1).bytes() == b"abcde"
