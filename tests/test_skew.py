"""Operators against brute force, with one key holding a third of the rows or more."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import duplicates as dup, holds, placing, views as vw
from memspark.operators.graph import bfs, neighbours
from memspark.operators.matching import substring_pairs
from memspark.operators.ranking import top_per_group
from memspark.operators.search import vector_search
from memspark.sources.transcripts import import_transcript, numbered_lines

BASE = dt.datetime(2024, 1, 1)


def brute_holds(rows, ttl, holders):
    state, out = {}, {}
    for i, k, h, t, op in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        held = state.get(k)
        if op == "release":
            if held and (held[0] == h or h == ""):
                state[k] = None
            continue
        if held and t < held[1] and (not holders or held[0] != h):
            out[i] = False
        else:
            state[k], out[i] = (h, t + ttl), True
    return out, state


@pytest.mark.parametrize("seed,span", [(0, 60000), (1, 5000)])
def test_holds(spark, seed, span):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        op = "release" if rnd.random() < 0.2 else "acquire"
        h = rnd.choice("abcd") if op == "acquire" or rnd.random() < 0.8 else ""
        rows.append((i, "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(60)}", h, rnd.randrange(span), op))
    df = spark.createDataFrame(
        [(i, k, h, BASE + dt.timedelta(seconds=t), op) for i, k, h, t, op in rows], "event_id long, action_id string, holder_id string, ts timestamp, op string"
    )
    want, _ = brute_holds(rows, 50, True)
    for rows_of_piece in (20, 100_000):
        got = holds.replay_holds(df, [F.col("action_id")], F.col("ts"), F.col("event_id"), 50, F.col("holder_id"), F.col("op") == "acquire", rows_of_piece)
        assert {r.id: r.granted for r in got.collect() if r.id in want} == want
    want, _ = brute_holds([(*r[:4], "acquire") for r in rows], 50, False)
    got = holds.dedup_window(df, ["action_id"], "ts", "event_id", 50)
    assert {r.event_id: not r.is_duplicate for r in got.collect()} == want
    at = span // 2
    _, state = brute_holds([r for r in rows if r[3] <= at], 50, True)
    _, live = holds.replay_leases(df, 50, str(BASE + dt.timedelta(seconds=at)))
    assert {r.action_id: r.holder_id for r in live.collect()} == {k: s[0] for k, s in state.items() if s and s[1] > at}


@pytest.mark.parametrize("ttl,holders", [(100_000, False), (700, False), (100_000, True), (700, True)])
def test_holds_of_a_burst_stay_in_pieces(spark, ttl, holders):
    """One key, many events within one lifetime or a few, much more than a piece."""
    rnd = random.Random(ttl)
    rows = [(i, "hot", rnd.choice("abc") if rnd.random() < 0.97 else "", rnd.randrange(5000), "release" if rnd.random() < 0.05 else "acquire") for i in range(4000)]
    rows = [r for r in rows if r[2] or r[4] == "release"] if holders else [(*r[:4], "acquire") for r in rows]
    df = spark.createDataFrame(
        [(i, k, h, BASE + dt.timedelta(seconds=t), op) for i, k, h, t, op in rows], "event_id long, action_id string, holder_id string, ts timestamp, op string"
    ).repartition(5)
    want, _ = brute_holds(rows, ttl, holders)
    who = (F.col("holder_id"), F.col("op") == "acquire") if holders else (None, None)
    got = holds.replay_holds(df, [F.col("action_id")], F.col("ts"), F.col("event_id"), ttl, *who, 64)
    assert {r.id: r.granted for r in got.collect() if r.id in want} == want
    slim = df.select(F.col("action_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"), F.col("holder_id").alias("holder"), (F.col("op") == "acquire").alias("takes"))
    places = holds._stepped(slim, ttl * 1_000_000, holders).select("pos").collect()
    assert sorted(r.pos for r in places) == list(range(len(rows)))


def test_next_values_and_places(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(9)}", i, i if rnd.random() < 0.02 else None, (i, "x") if rnd.random() < 0.3 else None) for i in range(2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, a long, b struct<p:long,q:string>").repartition(6)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "37")
    try:
        got = {r.t: r for r in placing.next_values(df, "k", ["t"], ["a", "b"]).collect()}
        place = {r.t: r.pos for r in placing.rank_rows(df, "k", ["t"]).collect()}
    finally:
        spark.conf.set(size, old)
    for k in {r[0] for r in rows}:
        a = b = None
        group = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, (_, t, own_a, own_b) in reversed(list(enumerate(group))):
            assert (got[t].next_a, got[t].next_b and tuple(got[t].next_b), place[t]) == (a, b, i)
            a, b = own_a if own_a is not None else a, own_b or b


def test_dedup_literals(spark):
    rows = [(1, "s1", 0), (2, "s1", 299), (3, "s1", 300), (4, "s2", 10), (5, "s1", 599), (6, "s1", 600)]
    df = spark.createDataFrame([(i, s, BASE + dt.timedelta(seconds=t)) for i, s, t in rows], "id long, s string, ts timestamp")
    got = {r.id: r.is_duplicate for r in holds.dedup_window(df, ["s"], "ts", "id").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_top_per_group_large_k(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"))
    got = top_per_group(df, ["g"], [F.desc("id")], 1500, spread=F.col("id"))
    assert got.filter("g = 'hot'").count() == 1500 and got.filter("g = 'hot'").agg(F.min("id")).first()[0] == 9000 - 3 * 1500
    with pytest.raises(ValueError):
        top_per_group(df, ["g"], [F.desc("id")], 1500)


def test_substring_pairs(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab%_c ") for _ in range(rnd.randrange(1, 14))) for _ in range(400)] + ["aaaa"] * 300
    needles = ["".join(rnd.choice("ab%_c ") for _ in range(rnd.randrange(1, 6))) for _ in range(60)] + ["", "zzz"]
    got = substring_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(n, t) for n in needles for t in texts if n and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_flag_duplicates_with_one_shared_prefix(spark):
    rnd = random.Random(5)
    names = sorted({"sup" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 7))) for _ in range(150)} | {"x" * 25, "x" * 24, "ab", "abc", "zup" + "abcab"})
    rows = [(f"e{i:04d}", "p", n, "T") for i, n in enumerate(names)] + [(f"u{i:04d}", "p", n.upper(), "T") for i, n in enumerate(names) if i % 3 == 0] + [("o1", "q", names[0], "T")]
    found = dup.flag_duplicates(spark.createDataFrame(rows, "id string, project string, name string, type string")).collect()
    exact = {(r.source_id, r.target_id) for r in found if r.match_type == "exact"}
    assert exact == {(f"e{i:04d}", f"u{i:04d}") for i in range(len(names)) if i % 3 == 0}
    def want(may):
        return {
            (f"e{i:04d}", f"e{j:04d}", round(1 - 0.1 * edit_distance(a, b), 2))
            for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)
            if min(len(a), len(b)) >= 3 and edit_distance(a, b) <= 2 and may(a, b)
        }

    assert {(r.source_id, r.target_id, r.confidence) for r in found if r.match_type == "fuzzy"} == want(lambda a, b: True)
    limited = dup.flag_duplicates(spark.createDataFrame(rows, "id string, project string, name string, type string"), prefix=3, longest=20).collect()
    assert {(r.source_id, r.target_id, r.confidence) for r in limited if r.match_type == "fuzzy"} == want(lambda a, b: a[:3] == b[:3] and max(len(a), len(b)) <= 20)


def test_canonical_ids_of_a_long_chain(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", "confirmed") for i in range(40)] + [("z1", "z2", "confirmed"), ("z2", "z3", "pending")]
    got = {r.id: r.canonical_id for r in dup.canonical_ids(spark.createDataFrame(rows, "source_id string, target_id string, status string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "z1": "z1", "z2": "z1"}


def brute_bfs(edges, seeds, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, front = {s: 0 for s in seeds}, set(seeds)
    for d in range(1, depth + 1):
        front = {n for f in front for n in near.get(f, ())} - set(out)
        out.update({n: d for n in front})
    return out


@pytest.mark.parametrize("depth", [2, 5])
def test_bfs_with_a_hub_and_more_queries_than_bits(spark, depth):
    rnd = random.Random(7)
    edges = [("hub", f"n{rnd.randrange(60)}") if rnd.random() < 0.2 else (f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(100)]
    queries = {q: {f"n{rnd.randrange(90)}" for _ in range(2)} for q in range(70)}
    e = spark.createDataFrame([("p", a, b, 0.9) for a, b in edges] + [("p", "n1", "n2", 0.1), ("other", "n1", "far", 0.9)], "project string, source_id string, target_id string, confidence double")
    s = spark.createDataFrame([(q, "p", n) for q, ns in queries.items() for n in ns], "query_id long, q_project string, entity_id string")
    got = {}
    for r in bfs(s, e, depth).collect():
        assert (r.query_id, r.node) not in got
        got[(r.query_id, r.node)] = r.depth
    assert got == {(q, n): d for q, ns in queries.items() for n, d in brute_bfs(edges, ns, depth).items()}


def test_neighbours_leave_out_only_the_start_itself(spark):
    ents = spark.createDataFrame([("a", "p", "Alpha"), ("b", "p", "Beta"), ("c", "p", "Gamma alpha"), ("d", "p", "Delta")], "id string, project string, name string").withColumns({"type": F.lit("T"), "subtype": F.lit(""), "confidence": F.lit(0.5)})
    edges = spark.createDataFrame([("p", "a", "b", 0.1), ("p", "b", "c", 0.9), ("p", "c", "d", 0.9)], "project string, source_id string, target_id string, confidence double")
    ask = lambda n: [r.id for r in neighbours(spark.createDataFrame([("q", "", n)], "query_id string, project string, name string"), ents, edges).orderBy("rank").collect()]
    assert ask("ALPHA") == ["a", "b", "c", "d"] and ask("delta") == ["b", "c"]


def test_vector_search_passes_and_ties(spark):
    rnd = random.Random(9)
    vec = lambda: [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(3)]
    docs = [(f"d{i:03d}", "p" if i % 2 else "q", vec()) for i in range(200)] + [("bad", "p", [1.0])]
    qs = [(i, "p" if i % 3 == 0 else "", vec()) for i in range(11)]
    d = spark.createDataFrame(docs, "doc_id string, project string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(qs, "query_id long, project string, embedding array<float>")

    def score(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) + 0.0 if na and nb else 0.0

    want = {}
    for i, p, e in qs:
        hits = sorted((-score(e, v), n) for n, dp, v in docs if len(v) == 3 and p in ("", dp))[:5]
        want[i] = [(n, -s + 0.0) for s, n in hits]
    for blocks in ((512, 4096), (3, 16)):
        got = {}
        for r in vector_search(q, d, 5, *blocks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert got == want


def test_locations_grid(spark):
    rnd = random.Random(2)
    locs = [(i, f"l{i}", "LOCATION", rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.random()) for i in range(300)]
    pts = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(20)]
    got = vw.locations_near_points(
        spark.createDataFrame(pts, "point_id long, lat double, lon double"),
        spark.createDataFrame(locs, "id long, name string, type string, latitude double, longitude double, confidence double"), 30, 1000,
    )
    d = 30 / 111.0
    assert {(r.point_id, r.location_id) for r in got.collect()} == {(p[0], x[0]) for p in pts for x in locs if abs(p[1] - x[3]) <= d and abs(p[2] - x[4]) <= d}


def test_line_numbers_in_a_split_file(spark, tmp_path):
    lines = ['{"type":"tool_use","n":%d}' % i if i % 3 else "" for i in range(5000)]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        numbered = numbered_lines(spark, str(tmp_path / "t.jsonl"))
        assert numbered.rdd.getNumPartitions() > 1
        assert [r.value for r in numbered.orderBy("line_no").collect()] == lines
        done = import_transcript(numbered, "p", "session-long-name", "2024-01-01 00:00:00").collect()
        assert {(r.id[:12], r.id.split("-")[-1]) for r in done} == {("imp-session-", str(i)) for i in range(5000) if i % 3} and len({r.id for r in done}) == len(done)
        assert import_transcript(numbered, "p", "session-long-name", "2024-01-01 00:00:00", spark.createDataFrame(done)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_steps_are_numbered_across_slices(spark):
    rows = [("hot" if i % 3 else f"t{i % 7}", f"s{i:05d}", BASE + dt.timedelta(seconds=(i * 37) % 4000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "trace_id string, id string, created_at timestamp")
    got = {r.id: r.step_index for r in vw.number_steps(df, ["created_at", "id"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        want.update({r[1]: n for n, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])))})
    assert got == want
