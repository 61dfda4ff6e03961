"""Plans of all registered queries: no nested-loop joins, no Python outside the named queries, filters at the scan."""

import re

from memspark.operators.index import build_keyword_index, read_for_queries, write_keyword_index
from memspark.operators.views import timeline
from memspark.plans import load_registry
from memspark.plans.views import spark_view

PYTHON = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInArrow")
# Exact replay of holds, exact vector scan and the BLAKE2b embedder.
PYTHON_QUERIES = {
    "vector_topk", "vector_mixed_sizes", "rrf_fuse", "diversity_cap", "hybrid_search", "smart_search", "hash_embed", "dedup_window", "dedup_window_default",
    "dedup_counters", "capture_observations", "lease_replay", "lease_live", "lease_release", "vector_stored_topk", "vector_index_change",
}


# Made of the engines and traversals tested by name here; they write intermediate tables, so planning them takes a run.
EAGER = {"rrf_fuse", "smart_search", "graph_bfs", "bm25_stored_topk", "vector_stored_topk", "vector_index_change", "index_stream_state"}


def test_registered_plans(spark, sf_dir):
    nested, python = {}, set()
    for name, q in load_registry().items():
        if name in EAGER:
            continue
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        if re.search(r"CartesianProduct|NestedLoop", plan):
            nested[name] = True
        if any(p in plan for p in PYTHON):
            python.add(name)
    assert not nested
    assert python <= PYTHON_QUERIES


def test_every_query_has_sql_or_a_reason():
    without = {n for n, q in load_registry().items() if q.oracle() is None}
    assert without == {"hash_embed"}


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "obs")
    spark_view(spark, sf_dir, "observations").write.partitionBy("project").parquet(path)
    found = timeline(spark.read.parquet(path), project="src3", hook="user_prompt").select("id", "created_at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and re.search(r"PartitionFilters: \[[^\]]*src3", plan)
    assert "EqualTo(hook_type,user_prompt)" in plan and "narrative" not in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    plan = load_registry()["bm25_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    semi = plan.index("LeftSemi")
    assert "HashAggregate(keys=[term" in plan[:semi], "the wanted terms are joined below the aggregation"


def test_stored_index_reads_only_the_buckets_of_its_terms(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_keyword_index(build_keyword_index(docs, project_col=None), str(tmp_path / "i"), 32)
    queries = spark.createDataFrame([("q", "", "thing that")], "query_id string, project string, query string")
    plan = read_for_queries(queries, str(tmp_path / "i"), 32).postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan)


def test_plain_reads_are_not_dealt_out(spark, sf_dir):
    for name in ("diagnose", "status_report", "timeline", "decay"):
        assert "REPARTITION_BY_NUM" not in load_registry()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
