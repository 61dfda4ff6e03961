"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and run in full; rows go to the noop sink, so nothing is pruned and nothing is collected.
Arguments name other queries to time instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tokenize_postings", "bm25_topk", "vector_topk", "graph_topk", "hybrid_search", "smart_search", "redact_text", "capture_observations",
    "dedup_window", "synthetic_compress", "entity_extract", "relation_extract", "entity_duplicates", "session_summary", "consolidate_memories",
    "decay", "ttl_evict", "patterns_detect", "similar_memories", "context_assembly", "lease_replay", "action_frontier", "hash_embed",
)


def main() -> None:
    from memspark.plans import load_registry
    from memspark.runtime import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="memspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    # Start the JVM's and the Python workers' machinery once, outside the times.
    registry["vector_topk"](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "memspark_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
