"""The queries of this package, each over its whole table with the parameters of production, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import chat, decontaminate, fill_middle, html_extract, line_dedup, merkle, metric_topk, near_dedup, personal_data, piece_codec, quality, repeats, sharding
from memspark.llm.common import table

TOKENIZERS = os.environ.get("MEMSPARK_TOKENIZERS", "/opt/tokenizers")
SHARD_BYTES = 1 << 20
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digest(table(spark, sf_dir, "documents"), PIECES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op6_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return metric_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), with_text=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.shard(docs, SHARD_BYTES).drop("text")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat": op5_chat,
    "op6_metric_topk": op6_metric_topk,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_repeats": op9_repeats,
    "op10_html_extract": op10_html_extract,
    "op11_merkle": op11_merkle,
    "op12_personal_data": op12_personal_data,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_metric_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""",
    "op8_sharding": sharding.oracle(SHARD_BYTES),
    "op11_merkle": merkle.oracle(),
    "op13_fill_middle": fill_middle.ORACLE,
}
