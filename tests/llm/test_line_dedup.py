"""Line dedup against all pairs of lines; the plan holds no Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from memspark.llm import line_dedup as L


def words(line):
    return [w for w in re.split(r"[^\w]|_", line.lower()) if w]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, similarity=L.SIMILARITY):
    """The kept text of each row, by edit similarity of all pairs."""
    lines = [(i, None if t is None else t.split("\n")) for i, t in rows]
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        for place, line in enumerate(lines[k][1] or ()):
            if len(words(line)) >= L.MIN_WORDS:
                first.setdefault(tuple(words(line)), (k, place))
    group = {w: w for w in first}

    def find(w):
        while group[w] != w:
            w = group[w]
        return w

    every = sorted(first)
    bags = {w: Counter(w) for w in every}
    for x, a in enumerate(every):
        for b in every[:x]:
            longer = max(len(a), len(b))
            limit = int((1 - similarity) * longer + 1e-9)
            # Words that the other line lacks have to be edited.
            if abs(len(a) - len(b)) <= limit and len(bags[a].keys() & bags[b].keys()) and (bags[a] & bags[b]).total() >= longer - limit and edit(a, b) <= limit:
                group[find(a)] = find(b)
    rank = {k: n for n, k in enumerate(order)}
    least = {}
    for w in every:
        at = (rank[first[w][0]], first[w][1])
        least[find(w)] = min(least.get(find(w), at), at)
    out = []
    for k, (i, ls) in enumerate(lines):
        kept = [line for place, line in enumerate(ls or ()) if len(words(line)) < L.MIN_WORDS or least[find(tuple(words(line)))] == (rank[k], place)]
        out.append((i, None if ls is None else "\n".join(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(4)
    draw = lambda n: [f"word{rng.randint(0, 300)}" for _ in range(n)]
    bases = [draw(rng.choice([3, 6, 40, 120, 300])) for _ in range(12)] + [[f"word{k}" for k in range(290)]]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = f"word{rng.randint(0, 300)}"
            text.append(rng.choice(["", "- ", "* "]) + " ".join(line).title() + rng.choice(["", ".", "!"]))
            text += rng.choice([[], [""], ["Two words"], ["---"]])
        rows.append((i, "\n".join(text)))
    return rows + [(None, " ".join(bases[0])), (100, None), (101, ""), (102, "\n\n")]


def test_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS place", "2 AS sim")
    out = L.dedup_lines(df, counts=True)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(rows)
    assert all(r.n_cut == len((dict(rows)[r.doc_id] or "").split("\n")) - len((r.text or "").split("\n")) or r.text == "" for r in got if r.doc_id is not None)
    left = L.dedup_lines(df, drop_empty=True).count()
    assert left == sum(t is None or bool(t.strip()) or t == dict(rows)[i] for i, t in brute(rows))


def test_repeats_and_empty(spark):
    rows = [(1, "one two three\nfour five six")] * 2 + [(2, "One, two: three!\nnew line of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(df).collect())
    assert got == [(1, rows[0][1])] * 2 + [(2, "new line of words")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_recall_on_the_given_table(spark):
    """Of all pairs of lines by edit similarity alone, nine in ten end in one group; no group has a line that isn't linked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classes = {}
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            classes.setdefault(tuple(words(line)), (r.doc_id, line))
    classes.pop((), None)
    every = list(classes)
    holders = {}
    for k, w in enumerate(every):
        for pair in set(zip(w, w[1:])):
            holders.setdefault(pair, []).append(k)
    shared = {}
    for ks in holders.values():
        if len(ks) <= 60:
            for i, a in enumerate(ks):
                for b in ks[:i]:
                    shared[b, a] = shared.get((b, a), 0) + 1
    pairs = []
    for (a, b), n in shared.items():
        limit = max(len(every[a]), len(every[b])) // 4
        if limit and n >= min(len(every[a]), len(every[b])) - 3 - 2 * limit and abs(len(every[a]) - len(every[b])) <= limit and edit(every[a], every[b]) <= limit:
            pairs.append((a, b))
    assert len(pairs) > 200
    hashed = spark.createDataFrame([(k, list(w)) for k, w in enumerate(every)], "k int, w array<string>").select("k", F.xxhash64("w").alias("node"))
    group = {r.k: r["first"] for r in L.line_groups(docs).join(hashed, "node").collect()}
    met = [group.get(a, -1) == group.get(b, -2) for a, b in pairs]
    assert sum(met) >= 0.9 * len(met), sum(met) / len(met)
    linked = {k for pair in pairs for k in pair}
    copies = {r.node for r in L.lines_of(docs).where("node IS NOT NULL").groupBy("node").count().where("count > 1").collect()}
    nodes = {r.k: r.node for r in hashed.collect()}
    assert all(k in linked or nodes[k] in copies for k in group)


def test_edits_are_counted_in_words(spark):
    rng = random.Random(9)
    draw = lambda n: [f"word{rng.randint(0, 5000)}" for _ in range(n)]
    rows = []
    for n in [4, 5, 7, 8, 9, 11, 12, 20, 33, 60, 300]:
        for _ in range(4):
            line = draw(n)
            near, far = list(line), list(line)
            near[rng.randrange(n)] = draw(1)[0]
            for at in rng.sample(range(n), n // 4 + 1):
                far[at] = f"other{at}"
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(near)), (len(rows) + 2, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_cut for r in L.dedup_lines(df, counts=True).collect()}
    assert all(got[i] == 0 and got[i + 2] == 0 for i, _ in rows[::3])
    found = [got[i + 1] for i, _ in rows[::3]]
    assert set(found) <= {0, 1} and sum(found) >= 0.9 * len(found), found


def test_very_long_lines(spark):
    """Votes run over their lanes without harm."""
    long = [f"w{i % 3000}" for i in range(20_000)]
    other = list(long)
    other[17] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long)))]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_short_and_unspaced_lines(spark):
    thai, chinese = "\u0e01\u0e34\u0e19", "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65"
    texts = [f"Read more\n---\nShare\n{chinese}\n{thai}", f"read more!\n---\nshare\nRead less\n{chinese}\u3002", f"{chinese[:-1]}\u8dd1\n{thai[0]}\u0e35{thai[2]}", f"{chinese[:4]}", f"{chinese[:3]}\u51b7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got == {0: texts[0], 1: "---\nRead less", 2: texts[2].split("\n")[1], 3: texts[3], 4: texts[4]}


def test_large_blocks_meet_on_rare_words(spark):
    """No close pair of a large block is lost, and those that are not close give no rows, however many they are."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(12)]
    lines = []
    for _ in range(150):
        line = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randint(0, 2000)}" for _ in range(rng.choice([4, 5, 8, 9, 12, 23, 24, 25]))]
        lines.append(tuple(line))
        for edits in (1, 2, len(line) // 4, len(line) // 4 + 1):
            other = list(line)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[], [f"w{rng.randint(0, 2000)}"], [rng.choice(common), other[at]]])
            if len(other) > 3:
                lines.append(tuple(other))
    lines = sorted(set(lines))
    named = spark.createDataFrame([(7, k, list(w)) for k, w in enumerate(lines)], "block long, node long, words array<string>")
    named = named.select("block", "node", F.expr("struct(size(words) AS n, 0L AS x)").alias("bits"), F.col("node").alias("label"), F.transform("words", lambda w: F.hash(w)).alias("hashes"))
    assert len(lines) > L.MEET
    close = {(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if abs(len(a) - len(b)) <= max(len(a), len(b)) // 4 and edit(a, b) <= max(len(a), len(b)) // 4}
    assert len(close) > 100
    assert {(r.a, r.b) for r in L._apart(named, L.SIMILARITY).collect()} == close
    rare = L._rare_words(named.withColumn("spelt", F.lit("")), L.SIMILARITY).groupBy("block").count()
    assert sum(r["count"] ** 2 for r in rare.collect()) < len(lines) ** 2 / 5


def test_words_of_a_line_are_cut_once_and_leave_eight_numbers(spark, monkeypatch):
    """All lines are read into words once, not again to mark what is cut, and no word of theirs is written or moved."""
    calls, cut = [], L.lines_of
    monkeypatch.setattr(L, "lines_of", lambda *a, **k: calls.append(1) or cut(*a, **k))
    line = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(line)), (2, " ".join(["changed", *line[1:]])), (3, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(df).collect()} == {1: rows[0][1], 2: "", 3: "too short"}
    assert len(calls) == 1
    blocks = {r.doc_id: r.blocks for r in cut(df).collect()}
    assert blocks[3] is None and len(blocks[1]) == 8 and sum(a == b for a, b in zip(blocks[1], blocks[2])) in (6, 7)


def test_candidates_come_from_bits_without_words(spark, monkeypatch):
    """The SimHash comes from the eight numbers, a block without words is none, and words are fetched for few lines."""
    fetched, texts = [], L._texts
    monkeypatch.setattr(L, "_texts", lambda df, classes, nodes: fetched.append(nodes.count()) or texts(df, classes, nodes))
    rng = random.Random(8)
    common = [f"c{k}" for k in range(5)]
    line = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 100_000)}" for _ in range(n)]
    # Few words, many times: counts don't run into the blocks of others.
    lines = [line(30) for _ in range(400)] + [[f"x{i}"] * rng.randint(900, 1500) for i in range(40)]
    lines += [[*lines[0][:-1], "other"], [*lines[400], "other"]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    cut = {r.doc_id for r in L.dedup_lines(df, counts=True).collect() if r.n_cut}
    assert cut == {440, 441}
    assert sum(fetched) < 60
    made = L.lines_of(df).select("doc_id", "blocks", L.simhash("blocks").alias("x")).collect()
    for r in made:
        bits = 0
        for i, v in enumerate(r.blocks):
            lanes = [v >> 8 * k & 255 for k in range(7)]
            bits |= sum(1 << (8 * k + 7 - i) for k in range(7) if 2 * lanes[k] > 15 * (v >> 56) and lanes[k] >= min((15 * (v >> 56) >> 1) + 1, 256))
        assert r.x == bits
    assert all(r.blocks.count(0) == 7 for r in made if 400 <= r.doc_id < 440)


def test_larger_blocks_meet_by_words(spark, monkeypatch):
    """Beyond DIRECT rows a block is compared on hashed words, and nothing else comes out."""
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, size in (("DIRECT", 2), ("DIRECT_TILE", 2)):
        monkeypatch.setattr(L, name, size)
        assert sorted(((r.doc_id, r.text) for r in L.dedup_lines(df).collect()), key=repr) == brute(rows)
