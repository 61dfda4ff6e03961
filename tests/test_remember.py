"""Memories of one call: equal rows stay apart, the same call adds none."""

from pyspark.sql import functions as F

from memspark.operators import orchestration as orch, upserts as up

MEMORIES = "id string, project string, type string, tier string, title string, content string, strength double, is_latest boolean, created_at timestamp, updated_at timestamp"
NEW = "project string, type string, title string, content string, tier string, strength double"


def test_equal_rows_of_a_call(spark, monkeypatch):
    monkeypatch.setattr(up, "COPIES", 7)
    rows = [("p", "", None, "same text", None, 0.0)] * 30 + [("p", "bug", None, "same text", None, 0.0), ("q", None, "t", "other", "working", 0.5), ("q", None, None, "", None, 1.0)]
    new, none = spark.createDataFrame(rows, NEW), spark.createDataFrame([], MEMORIES)
    table, _, rejected = up.remember(none, new, "2024-01-01 00:00:00")
    assert table.count() == 32 == table.select("id").distinct().count() and rejected.count() == 1
    again, _, _ = up.remember(table, new, "2024-01-01 00:00:00")
    assert again.count() == 32
    later, _, _ = up.remember(table, new, "2024-01-02 00:00:00")
    assert later.count() == 64


def test_summary_rows_are_bounded(spark):
    actions = spark.range(1000).select(F.concat(F.lit("a"), "id").alias("id"), F.lit("p").alias("project"), F.concat(F.lit("t"), "id").alias("title"))
    groups = spark.range(1000).select(F.lit("g").alias("group_id"), F.concat(F.lit("a"), "id").alias("action_id"), F.col("id").cast("int").alias("pos"))
    row = orch.crystallize(groups, actions).first()
    assert row.title == "Crystallized: 1000 actions" and row.description.count(";") == orch.SHOWN - 1
    assert orch.crystallize(groups, actions, None).first().description.count(";") == 999
    assert orch.crystallize_lines(groups, actions).count() == 1000
