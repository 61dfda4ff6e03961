"""Sharding by extendible hashing, in DataFrame operations only.

Rows hash to a string of bits. A bucket holds the rows of one prefix; only a bucket over its byte limit splits on the
next bit. The sizes of all prefixes of 16 bits come from one aggregation of at most 65,536 leaves; a leaf still too
large goes on with its next 16 bits, so the rounds don't grow with the data, and a hot prefix costs no more than others.
The bits are those of the key's MD5 (64), then of the text's (64). Rows alike in both are dealt on by their place in a
stored table, so even a third of all rows being copies of one row is cut into shards that fit.

Edge cases: null text has no bytes; a null key hashes like the word "null"; a row larger than the limit gets a shard of
its own; rows that repeat stay and count each; an empty table gives no shards; other columns are carried on, and columns
named shard, depth or shard_bytes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import stored

BITS = 16
DIGITS = BITS // 4
ROUNDS_BY_KEY = 16 // DIGITS
ADDED = ("shard", "depth", "shard_bytes")


def _bits(hexes: Column, at: int) -> Column:
    """The 16 bits from a given hex digit on, as a number."""
    return F.conv(F.substring(hexes, at * DIGITS + 1, DIGITS), 16, 10).cast("int")


def _directory(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """For each leaf (old prefix, next 16 bits) the shard it falls in; depth is null where no prefix of the leaf fits.

    rows: columns prefix, leaf, bytes. depth: bits of the old prefixes.
    """
    leaves = rows.groupBy("prefix", "leaf").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    first = 0 if depth == 0 else 1
    steps = leaves.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(BITS)))).withColumn("q", F.expr(f"shiftright(leaf, {BITS} - d)"))
    sizes = steps.groupBy("prefix", "d", "q").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fit = sizes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    best = (
        steps.select("prefix", "leaf", "d", "q")
        .join(fit, ["prefix", "d", "q"])
        .groupBy("prefix", "leaf")
        .agg(F.min_by(F.struct("d", "q", "shard_bytes"), "d").alias("at"))
    )
    bits = F.when(F.col("at.d") == 0, "").otherwise(F.expr("lpad(bin(at.q), at.d, '0')"))
    return leaves.select("prefix", "leaf").join(best, ["prefix", "leaf"], "left").select(
        "prefix",
        "leaf",
        F.concat("prefix", bits).alias("shard"),
        (F.col("at.d") + depth).alias("depth"),
        F.col("at.shard_bytes").alias("shard_bytes"),
        F.concat("prefix", F.expr(f"lpad(bin(leaf), {BITS}, '0')")).alias("whole"),
    )


def shard(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, with the shard's bits (shard), their number (depth) and the bytes of the shard (shard_bytes)."""
    kept = [c for c in df.columns if c not in ADDED]
    named = df.select(
        *kept,
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")).alias("key_hex"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("own_bytes"),
    )
    waiting, done, depth, step = named.withColumn("prefix", F.lit("")), None, 0, 0
    while True:
        if step < ROUNDS_BY_KEY:
            leaf = _bits(F.col("key_hex"), step)
        elif step < 2 * ROUNDS_BY_KEY:
            leaf = _bits(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), step - ROUNDS_BY_KEY)
        else:
            if step == 2 * ROUNDS_BY_KEY:
                waiting = stored(waiting.withColumn("place", F.monotonically_increasing_id()))
            leaf = _bits(F.md5(F.col("place").cast("string").cast("binary")), step - 2 * ROUNDS_BY_KEY)
        rows = waiting.withColumn("leaf", leaf)
        found = stored(_directory(rows.select("prefix", "leaf", F.col("own_bytes").alias("bytes")), limit, depth))
        mapped = rows.join(found, ["prefix", "leaf"])
        settled = mapped.where(F.col("depth").isNotNull()).select(*kept, *ADDED)
        done = settled if done is None else done.unionByName(settled)
        if found.where(F.col("depth").isNull()).isEmpty():
            return done
        waiting = mapped.where(F.col("depth").isNull()).withColumn("prefix", F.col("whole")).drop("leaf", "whole", *ADDED)
        depth += BITS
        step += 1


def write_shards(df: DataFrame, limit: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One folder and one file for each shard."""
    out = shard(df, limit, key, text).withColumn("shard", F.concat(F.lit("s"), "shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """The same for tables whose leaves of 16 bits all fit."""
    return f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 4))::INTEGER AS p FROM documents),
u AS (SELECT d, p >> (16 - d) AS q, sum(n_bytes) AS shard_bytes, count(*) AS n FROM r, (SELECT CAST(unnest(range(17)) AS INTEGER) AS d) GROUP BY ALL),
m AS (SELECT r.p, min(u.d) AS d FROM (SELECT DISTINCT p FROM r) r JOIN u ON u.q = r.p >> (16 - u.d) WHERE u.shard_bytes <= {limit} OR u.n = 1 GROUP BY r.p)
SELECT r.doc_id, substr(lpad(bin(r.p), 16, '0'), 1, m.d) AS shard, m.d AS depth, CAST(u.shard_bytes AS BIGINT) AS shard_bytes, CAST(r.n_bytes AS BIGINT) AS n_bytes
FROM r JOIN m ON m.p = r.p JOIN u ON u.d = m.d AND u.q = r.p >> (16 - m.d)"""
