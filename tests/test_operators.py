"""Operators on small literals."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memspark.operators import governance as gov, lifecycle as life, orchestration as orch, upserts as up
from memspark.operators.capture import apply_compression, capture
from memspark.operators.duplicates import upsert_same_as
from memspark.operators.extraction import extract_relations, merge_entities, extract_entities
from memspark.operators.index import build_keyword_index, delete_documents, read_keyword_index, upsert_keyword_index, upsert_vectors, write_keyword_index
from memspark.operators.search import bm25_search, rrf_fuse
from memspark.operators.sessions import summarize_sessions
from memspark.sources import bundles

NOW = "2024-06-01 00:00:00"
T0 = dt.datetime(2024, 6, 1)


def days(n):
    return T0 - dt.timedelta(days=n)


def test_bm25_index_life(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "p", "jwt token parser"), ("d2", "q", "database pool"), ("d3", "p", "")], "doc_id string, project string, text string")
    ask = lambda index, text, project="", **kw: [r.doc_id for r in bm25_search(spark.createDataFrame([(1, project, text)], "query_id int, project string, query string"), index, **kw).orderBy("rank").collect()]
    index = build_keyword_index(docs)
    assert ask(index, "jwt") == ["d1"] and ask(index, "db") == ["d2"] and ask(index, "db", "p") == [] and ask(index, "the of") == []
    assert ask(index, "token", "p", scope="project") == ["d1"]
    write_keyword_index(index, str(tmp_path / "i"), buckets=4)
    stored = read_keyword_index(spark, str(tmp_path / "i"))
    assert ask(stored, "jwt") == ["d1"] and stored.docs.count() == 3
    changed = upsert_keyword_index(stored, build_keyword_index(docs.filter("doc_id = 'd1'").withColumn("text", F.lit("cache layer"))))
    assert ask(changed, "jwt") == [] and ask(changed, "cache") == ["d1"] and changed.docs.count() == 3
    assert delete_documents(changed, docs.filter("doc_id = 'd1'")).docs.count() == 2
    old = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, embedding array<double>")
    assert upsert_vectors(old, spark.createDataFrame([("a", [0.0, 1.0])], old.schema)).collect()[0].embedding == [0.0, 1.0]
    with pytest.raises(Exception, match="dimension mismatch"):
        upsert_vectors(old, spark.createDataFrame([("b", [1.0])], old.schema)).collect()


def test_rrf(spark):
    rows = spark.createDataFrame([("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "b", "y", 1), ("q", "b", "z", 2)], "query_id string, engine string, doc_id string, rank int")
    got = {r.doc_id: r.score for r in rrf_fuse(rows, 0).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 61 + 1 / 62, 9), "z": round(1 / 62, 9)}


def test_decay_literals(spark):
    rows = [("a", "semantic", 1.0, True, days(1), None), ("b", "semantic", 0.9, True, days(90), None), ("c", "semantic", 0.5, True, days(30), T0), ("d", "semantic", 0.5, True, days(30), None), ("e", "working", 0.05, True, days(90), None), ("f", "semantic", 0.05, False, days(90), None)]
    kept, gone, report = life.decay(spark.createDataFrame(rows, "id string, tier string, strength double, is_latest boolean, created_at timestamp, last_retrieved_at timestamp"), NOW)
    s = {r.id: r.strength for r in kept.collect()}
    assert s["a"] == pytest.approx(0.95) and s["c"] == pytest.approx(0.55) and s["c"] > s["d"] and s["e"] == s["f"] == 0.05
    assert [r.id for r in gone.collect()] == ["b"] and tuple(report.first()) == (4, 1, 3)


def test_capture_rejects_dedups_and_ends(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    use = json.dumps({"tool_name": "read", "tool_input": {"p": 1}, "tool_output": "password = hunter2-secret"})
    rows = [("post_tool_use", "s1", "p", "/w", at(0), use), ("post_tool_use", "s1", "p", "/w", at(10), use), ("nope", "s1", "p", "/w", at(1), use), ("post_tool_use", "s1", "p", "/w", at(2), "{bad"), ("session_end", "s1", "p", "/w", at(400), "{}"), ("session_end", "s1", "p", "/w", at(500), "{}")]
    done = capture(spark.createDataFrame(rows, "hook_type string, session_id string, project string, cwd string, ts timestamp, data string"))
    obs = done.observations.collect()
    assert len(obs) == 1 and obs[0].has_secrets and "hunter2" not in obs[0].tool_output + obs[0].raw
    assert sorted(r.reject_reason for r in done.rejected.collect()) == ["data must be valid JSON", "invalid hookType"]
    s = done.sessions.first()
    assert (s.status, s.started_at, s.ended_at) == ("completed", at(0), at(400))


def test_summary_literals(spark):
    rows = [("o1", "s", "p", "Fix login", "Looked at auth. Then more", ["auth", "API"], ["a.py"], ["Decided to use bcrypt for hashing."], days(3)), ("o2", "s", "p", "Edit", "Edited the handler; use bcrypt now", ["auth"], ["b.py", "a.py"], [], days(2))]
    obs = spark.createDataFrame(rows, "id string, session_id string, project string, title string, narrative string, concepts array<string>, files array<string>, facts array<string>, created_at timestamp").withColumn("compressed", F.lit(True))
    got = summarize_sessions(obs)
    s = got.summaries.first()
    assert s.title == "Session on auth" and s.narrative == "Looked at auth • Edited the handler; use bcrypt now" and s.concepts == ["auth", "api"]
    assert s.key_decisions == ["Decided to use bcrypt for hashing", "use bcrypt now"]
    assert [r.file for r in got.files.orderBy("first_at", "first_id", "first_pos").collect()] == ["a.py", "b.py"]
    assert summarize_sessions(obs.withColumn("compressed", F.lit(False))).summaries.count() == 0


def test_relations_literals(spark):
    docs = spark.createDataFrame([("1", "The parser depends on the lexer."), ("2", "v2 supersedes v2"), ("3", "Foo implements Bar, foo implements bar."), ("4", "runJob and loadData")], "id string, text string")
    got = {(r.id, r.source, r.target, r.type) for r in extract_relations(docs).collect()}
    assert got == {("1", "parser", "lexer", "DEPENDS_ON"), ("3", "Foo", "Bar", "IMPLEMENTS"), ("4", "runJob", "loadData", "RELATED_TO")}
    entities, sources = merge_entities(extract_entities(spark.createDataFrame([("1", "see src/a.py"), ("2", "and src/a.py by Jane Smith")], "id string, text string")))
    assert {(r.name, r.subtype, r.confidence) for r in entities.collect()} == {("src/a.py", "FILE", 0.7), ("Jane Smith", None, 0.4)} and sources.count() == 3


def test_table_changes(spark, tmp_path):
    slots = spark.createDataFrame([("p", "a", "old", T0)], "project string, slot_name string, content string, updated_at timestamp")
    assert up.set_slots(slots, spark.createDataFrame([("p", "a", "new", T0), ("p", "b", "x", days(1))], slots.schema)).orderBy("slot_name").collect()[0].content == "new"
    same = spark.createDataFrame([("a", "b", 0.9, "fuzzy", "rejected", days(2))], "source_id string, target_id string, confidence double, match_type string, status string, created_at timestamp")
    r = upsert_same_as(same, spark.createDataFrame([("a", "b", 0.8, "exact", T0)], "source_id string, target_id string, confidence double, match_type string, created_at timestamp")).first()
    assert (r.confidence, r.match_type, r.status) == (0.9, "exact", "rejected")
    acts = spark.createDataFrame([("1", "p", "t1", "completed", 1, T0), ("2", "p", "t2", "pending", 1, T0), ("3", "p", "t3", "pending", 1, T0), ("4", "q", "t4", "pending", 1, T0)], "id string, project string, title string, status string, priority int, created_at timestamp")
    deps = spark.createDataFrame([("2", "1"), ("3", "2"), ("4", "1")], "action_id string, dep_id string")
    assert [x.id for x in orch.frontier(acts, deps).collect()] == ["2"]
    mem = spark.createDataFrame([("m1",), ("m2",)], "id string")
    kept, audit, bad = gov.governance_delete(mem, spark.createDataFrame([("m1", "old", None), ("m2", "", "x")], "memory_id string, reason string, actor string"), NOW)
    assert [x.id for x in kept.collect()] == ["m2"] and audit.first().actor == "governance" and bad.count() == 1
    obs = spark.createDataFrame([("o1", False), ("o2", True)], "id string, compressed boolean")
    comp = spark.createDataFrame([("o1", "t", "T", "", [], "n", [], [], 5, 0.3)], "id string, type string, title string, subtitle string, facts array<string>, narrative string, concepts array<string>, files array<string>, importance int, confidence double")
    assert {x.id: (x.compressed, x.title) for x in apply_compression(obs, comp).collect()} == {"o1": (True, "T"), "o2": (True, None)}
    tables = {"sessions": spark.createDataFrame([("s1", "p", ""), ("s2", "q", "active")], "id string, project string, status string"), "memories": spark.createDataFrame([("m1", "p", "")], "id string, project string, tier string")}
    bundles.export_bundle(tables, str(tmp_path / "b"), "p")
    back = bundles.read_bundle(spark, str(tmp_path / "b"), ["sessions", "memories", bundles.MANIFEST])
    assert {r["table"]: r["rows"] for r in back[bundles.MANIFEST].collect()} == {"sessions": 1, "memories": 1}
    empty = {n: t.filter("false") for n, t in tables.items()}
    got = bundles.import_bundle(empty, back)
    assert got["sessions"].first().status == "completed" and got["memories"].first().tier == "semantic"
    bundles.create_snapshot(tables, str(tmp_path / "s"), "snap-1")
    assert bundles.read_snapshot(spark, str(tmp_path / "s"), "sessions", "snap-1").count() == 2
    merged = bundles.merge_tables({"sessions": tables["sessions"].filter("id = 's1'")}, tables)
    assert merged["sessions"].count() == 2


def test_vectors_of_mixed_sizes_are_asked_for_every_fifth_whole(spark, sf_dir):
    from memspark.plans import load_registry

    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 5 = 0").select("vec_id").collect()
    got = load_registry()["vector_mixed_sizes"](spark, sf_dir).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {r.vec_id: 5 for r in ids}
