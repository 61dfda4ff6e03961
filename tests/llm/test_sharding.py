"""Sharding: every shard fits, only oversized buckets split, nothing is lost."""

import hashlib

from memspark.llm.sharding import shard, write_shards


def brute(rows, limit):
    """Split a bucket of (bits, size, row) until it fits."""
    out = {}

    def go(bucket, depth):
        total = sum(s for _, s, _ in bucket)
        if total <= limit or len(bucket) == 1:
            for bits, _, row in bucket:
                out[row] = (bits[:depth], total)
            return
        for bit in "01":
            part = [x for x in bucket if x[0][depth] == bit]
            if part:
                go(part, depth + 1)

    go([(f"{int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16):064b}", len((t or "").encode()), i) for i, t in rows], 0)
    return out


def test_against_recursion(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for limit in (1 << 20, 20_000, 3_000):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.shard, r.shard_bytes) for r in shard(df, limit).collect()}
        assert got == brute(rows, limit)


def test_deep_and_identical_rows(spark):
    rows = [(1, "x" * 100)] * 40 + [(2, "y" * 1000), (None, None), (None, "z"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    out = shard(df.selectExpr("*", "'old' AS depth"), 350).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(len(r.text or ""))
    assert all(sum(v) <= 350 or len(v) == 1 for v in sizes.values())
    assert all(r.shard_bytes == sum(sizes[r.shard]) for r in out)
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


def test_empty_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc") for i in range(30)], "doc_id long, text string")
    assert shard(df.limit(0), 10).count() == 0
    write_shards(df, 12, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 30
    assert back.groupBy("shard").count().where("count > 4").count() == 0
