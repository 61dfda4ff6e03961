"""Personal data: patterns against their plain form, message passing against all labellings, labels that agree, odd rows."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm import personal_data as pd_
from memspark.llm.queries import QUERIES

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def sums(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sums(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ0129.@+- ()_é\n", max_size=40))
def test_patterns(text):
    assert pd_.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4041894974608795", "+1 (246) 555-1219", "1.2.3.004", "256.1.1.1", "a@b.c", "@", "x", " ", "-", ".", "0", "5", "+", "4041 8949-7460 8795"]), max_size=12))
def test_patterns_of_parts(parts):
    assert pd_.base_spans("".join(parts)) == brute("".join(parts))


def test_long_runs_take_linear_time():
    start = time.time()
    for unit in ("a", "1", "a@", "1.", "+1 ", "1 ", "-", "@", "(", "+1(", "a@b.", "é", " "):
        pd_.read_words(unit * (400_000 // len(unit)))
    assert time.time() - start < 60


def model(seed, skip=2.0):
    rnd = np.random.default_rng(seed)
    return pd_.Model(rnd.normal(size=(pd_.FEATURES, pd_.LABELS)), rnd.normal(size=(pd_.LABELS, pd_.LABELS)), np.full(pd_.LABELS, skip))


def exact(words, m):
    """Label probabilities over all labellings of words and groups."""
    n = len(words.labels)
    own = m.scores(np.array(words.shapes))
    groups = [g for g in sorted(set(words.groups)) if words.groups.count(g) > 1]
    out = np.zeros((n, pd_.LABELS))
    for labels in itertools.product(range(pd_.LABELS), repeat=n):
        if any(fixed and fixed != y for fixed, y in zip(words.labels, labels)):
            continue
        score = 0.0
        for i, y in enumerate(labels):
            open_ = not words.labels[i]
            score += own[i, y] if open_ else 0.0
            if words.joined[i]:
                score += m.chain[labels[i - 1], y]
                starts = open_ and not words.labels[i - 1] and labels[i - 1] == 0 or open_ and bool(words.labels[i - 1])
            else:
                starts = open_
            score -= pd_.UNSEEN * (starts and y > 0)
        weight = np.exp(score)
        for g in groups:
            members = [labels[i] for i in range(n) if words.groups[i] == g]
            weight *= sum(np.exp(sum(m.skip[h] for y in members if y == h)) for h in range(pd_.LABELS))
        for i, y in enumerate(labels):
            out[i, y] += weight
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", ["a1 b2 c3", "555-1219 x +1 (246) 555-1219", "one1one two three 3 4 four one1one", "12 +1 246 555 1219 a 7", "w@x y w@x z w@x"])
def test_message_passing_is_exact_on_trees(text):
    words = pd_.read_words(text)
    for seed in range(3):
        m = model(seed)
        got = pd_.marginals([words], m, rounds=120)
        assert np.abs(got - exact(words, m)).max() < 1e-6
        # The same in company.
        both = pd_.marginals([pd_.read_words("z1 z2"), words, pd_.read_words(text)], m, rounds=120)
        assert np.array_equal(both[-len(got) :], got)


def test_loops_come_close():
    words = pd_.read_words("abcd1 x abcd1 abcd1 y 5 abcd1")
    m = model(4, skip=1.0)
    assert np.abs(pd_.marginals([words], m, rounds=200) - exact(words, m)).max() < 0.1


def corpus(n=300):
    """Every kind once in a while, numbers that are none of them more often."""
    out = []
    for i in range(n):
        kind = ["mail user{0}.42@mail{0}.example.com now", "call +1 (2{0:02d}) 555-1{0:03d} now", "from 42.144.35.{0} on", "card 4041894974608795 was", "page {0} of 1{0} in 20{0:02d}", "plain words only"][i % 6]
        out.append((i, kind.format(i % 90)))
    return out


def test_labels_agree_over_a_document(spark):
    tests = [
        ("call +1 (246) 555-1219 or else 555-1219, ok", ["555-1219"]),
        ("+1 (246) 555-1219. Once more: (246) 555-1219. And again (246) 555-1219", ["(246) 555-1219", "(246) 555-1219"]),
        ("card 4041894974608795 and once more 4041.8949.7460.8795.", ["4041.8949.7460.8795"]),
        ("only 555-1219 here", []),
        ("2024 and 2024 and 2024", []),
        ("card 4041894974608795 and 4041894974608796", []),
    ]
    known = spark.createDataFrame(corpus(), "doc_id long, text string")
    df = known.union(spark.createDataFrame([(1000 + i, t) for i, (t, _) in enumerate(tests)], known.schema)).repartition(5)
    found = {r.doc_id: r.spans for r in pd_.find_personal_data(df, pd_.train(known)).collect()}
    for i, (text, want) in enumerate(tests):
        added = [text[s.start : s.end] for s in found[1000 + i] if not s.base]
        assert added == want, text
        assert [(pd_.KINDS.index(s.kind), s.start, s.end) for s in found[1000 + i] if s.base] == brute(text)
    assert not [s for i in range(300) for s in found[i] if not s.base]


def test_query_against_plain_patterns(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op12_personal_data"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    hits = 0
    for d in docs:
        want, g = brute(d.text or ""), got[d.doc_id]
        written = [f"{pd_.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert g.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(g.spans.split(",") if g.spans else [])
        assert g.n_added == len(g.spans.split(",") if g.spans else []) - len(want)
        hits += len(want)
    assert hits


def test_partitioning_changes_nothing(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(pd_.digest(df.coalesce(1)).collect())
    assert one == sorted(pd_.digest(df.repartition(13)).collect())


def test_odd_rows(spark):
    rows = [(None, "a@b.cd", "s"), (1, None, "s"), (2, "", "s"), (3, "é 😀 a@b.cd", "s"), (3, "é 😀 a@b.cd", "s"), (4, "+1 246 555 1219 " * 20_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("base", pd_.F.lit(1))
    got = sorted(pd_.digest(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.n_email for r in got] == [1, 0, 0, 1, 1, 0] and got[-1].n_phone == 20_000 or got[-1].n_phone == len([x for x in brute(rows[5][1]) if x[0] == 3])
    assert got[3].spans == got[4].spans == "email:4:10" and got[1].spans == got[2].spans == ""
    full = pd_.find_personal_data(df)
    assert full.columns == ["doc_id", "text", "base", "spans"] and full.count() == 6
    masked = {r.doc_id: r.text for r in pd_.mask_personal_data(df).collect()}
    assert masked[3] == "é 😀 [EMAIL]" and masked[1] is None and masked[2] == "" and "555" not in masked[4]
    assert pd_.digest(df.limit(0)).count() == 0
    assert pd_.digest(df.where("doc_id = 2")).collect()[0].spans == ""
