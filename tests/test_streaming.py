"""Streams give what the table operators give."""

import json

from pyspark.sql import functions as F

from memspark.operators.capture import capture
from memspark.operators.holds import dedup_window
from memspark.operators.search import bm25_search
from memspark.plans.views import spark_view
from memspark.sources.hooks import parse_hook_lines, read_hooks, stream_hooks
from memspark.streaming import capture as cap, counters, dedup, index as idx, sessions


def in_time_order(df, path, ts="ts", parts=4):
    """One file per time slice, written in order, so that every micro-batch follows the one before."""
    span = df.agg(F.min(F.unix_micros(ts)).alias("a"), F.max(F.unix_micros(ts)).alias("b")).first()
    width = (span["b"] - span["a"]) // parts + 1
    for i in range(parts):
        low = span["a"] + i * width
        df.filter(F.unix_micros(ts).between(low, low + width - 1)).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_dedup_stream_equals_table(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedup.STATE_PROVIDER)
    rows = spark_view(spark, sf_dir, "hooks").select("event_id", "session_id", "tool_name", "ts")
    path = str(tmp_path / "in")
    in_time_order(rows, path)
    kept = dedup.dedup_stream(stream_of(spark, path, rows.schema), ["session_id", "tool_name"], "ts", "event_id", 6 * 3600, "1 minute")
    got = {r.event_id for r in run(kept, "dedup_out", tmp_path).collect()}
    want = {r.event_id for r in dedup_window(rows, ["session_id", "tool_name"], "ts", "event_id", 6 * 3600).filter("NOT is_duplicate").collect()}
    assert got == want and len(want) < rows.count()


def test_capture_stream_equals_table(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedup.STATE_PROVIDER)
    rows = spark_view(spark, sf_dir, "hooks").select("hook_type", "session_id", "project", "cwd", "ts", "data")
    path = str(tmp_path / "in")
    in_time_order(rows, path)
    got = {r.id for r in run(cap.capture_stream(stream_of(spark, path, rows.schema)), "capture_out", tmp_path).collect()}
    want = {r.id for r in capture(rows).observations.collect()}
    assert got == want


def test_windowed_counts_stream(spark, sf_dir, tmp_path):
    rows = spark_view(spark, sf_dir, "hooks").select("project", "hook_type", "ts")
    path = str(tmp_path / "in")
    in_time_order(rows, path)
    got = run(counters.windowed_counts(stream_of(spark, path, rows.schema), "1 hour"), "count_out", tmp_path, "update")
    last = got.groupBy("window_start", "project", "hook_type").agg(F.max("n").alias("n"))
    want = counters.windowed_counts(rows, "1 hour")
    assert sorted(last.collect()) == sorted(want.collect())


def test_session_spans(spark):
    rows = spark.createDataFrame(
        [("a", "user_prompt", "2024-01-01 00:00:00"), ("a", "session_end", "2024-01-01 01:00:00"), ("b", "user_prompt", "2024-01-01 00:00:00"), ("b", "user_prompt", "2024-01-09 00:00:00")],
        "session_id string, hook_type string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.session_id, r.events, r.status) for r in sessions.session_spans(rows).collect())
    assert got == [("a", 2, "completed"), ("b", 1, "stuck"), ("b", 1, "stuck")]


def test_index_stream_replaces_documents(spark, tmp_path):
    schema = "doc_id string, project string, text string, ts timestamp"
    src, out = str(tmp_path / "src"), str(tmp_path / "idx")

    def add(rows):
        spark.createDataFrame(rows, "doc_id string, project string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    add([("d1", "p", "alpha beta", "2024-01-01 00:00:00"), ("d2", "p", "gamma", "2024-01-01 00:00:00")])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    idx.index_stream(stream(), out, str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    add([("d1", "p", "delta", "2024-01-02 00:00:00")])
    idx.index_stream(stream(), out, str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    terms = {(r.doc_id, r.term) for r in idx.current_index(spark, out).postings.collect()}
    assert terms == {("d1", "delta"), ("d2", "gamma")}
    idx.compact_index(spark, out, str(tmp_path / "packed"))
    queries = spark.createDataFrame([("q", "", "delta")], "query_id string, project string, query string")
    packed = str(tmp_path / "packed")
    assert [r.doc_id for r in bm25_search(queries, idx.current_index(spark, packed)).collect()] == ["d1"]
    # Another checkpoint starts at batch 0 again; neither the compacted rows nor newer texts are lost to it.
    add([("d3", "p", "epsilon", "2024-01-01 12:00:00"), ("d1", "p", "stale", "2023-12-31 00:00:00")])
    idx.index_stream(stream(), packed, str(tmp_path / "ck2"), available_now=True).awaitTermination(60)
    terms = {(r.doc_id, r.term) for r in idx.current_index(spark, packed).postings.collect()}
    assert terms == {("d1", "delta"), ("d2", "gamma"), ("d3", "epsilon")}


def test_index_stream_deletes_and_merges(spark, tmp_path):
    schema = "doc_id string, project string, text string, ts timestamp, deleted boolean"
    src, out = str(tmp_path / "src"), str(tmp_path / "idx")

    def add(*rows):
        made = spark.createDataFrame(list(rows), "doc_id string, project string, text string, ts string, deleted boolean")
        made.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def step(ck):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        idx.index_stream(stream, out, str(tmp_path / ck), available_now=True).awaitTermination(120)

    def state():
        return {(r.doc_id, r.term) for r in idx.current_index(spark, out).postings.collect()}

    add(("d1", "p", "alpha", "2024-01-01 00:00:00", False), ("d2", "p", "beta", "2024-01-01 00:00:00", None))
    add(("d3", "p", "gamma", "2024-01-01 01:00:00", False))
    add(("d1", None, None, "2024-01-02 00:00:00", True), ("d2", "p", "delta", "2024-01-02 00:00:00", False))
    step("ck")
    assert state() == {("d2", "delta"), ("d3", "gamma")}
    assert len(idx.merge_segments(spark, out, 2)) >= 2 and state() == {("d2", "delta"), ("d3", "gamma")}
    # The same batches again from another checkpoint, and an older text than the deletion: nothing comes back.
    step("ck2")
    add(("d1", "p", "old", "2024-01-01 12:00:00", False), ("d3", "p", "x", "2024-01-03 00:00:00", True), ("d3", "p", "y", "2024-01-03 00:00:00", False))
    step("ck")
    assert state() == {("d2", "delta")}
    while idx.merge_segments(spark, out, 2):
        assert state() == {("d2", "delta")}
    add(("d1", "p", "back", "2024-01-04 00:00:00", False))
    step("ck")
    assert state() == {("d2", "delta"), ("d1", "back")}


def test_hook_source_and_quarantine(spark, tmp_path):
    good = {"hookType": "post_tool_use", "sessionId": "s1", "project": "p", "timestamp": "2024-01-01T00:00:00Z", "data": {"tool_name": "read", "tool_output": "ok"}}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "hookType": "nope"}), json.dumps({**good, "sessionId": ""}), json.dumps({**good, "extra": 1}), json.dumps({**good, "timestamp": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    table = cap.checked(read_hooks(spark, str(tmp_path / "in")))
    reasons = sorted(r.reject_reason or "" for r in table.collect())
    assert reasons == ["", "invalid JSON", "invalid hookType", "sessionId required", "timestamp required", "unknown field extra"]
    bad = cap.quarantine_stream(stream_hooks(spark, str(tmp_path / "in")))
    assert run(bad, "bad_out", tmp_path).count() == 5
    feed = cap.live_feed(capture(parse_hook_lines(spark.read.text(str(tmp_path / "in"))).drop("parse_error")).observations.withColumnRenamed("created_at", "ts"))
    assert feed.columns == ["type", "session_id", "observation_id", "ts"]
