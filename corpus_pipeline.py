"""Cleaning a corpus: quality, repeated lines, near copies, benchmark passages, then ids of a fixed vocabulary.

Each stage takes the documents that the one before it kept, written as Parquet and read again, and returns the columns
of documents; the last adds the ids and their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import stored, table
from memspark.llm.decontaminate import decontaminate
from memspark.llm.line_dedup import dedup_lines
from memspark.llm.near_dedup import keep_one
from memspark.llm.piece_codec import encode_texts
from memspark.llm.quality import classify
from memspark.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither poor nor toxic."""
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that occur before; a document with no line of its own goes."""
    return _counted(dedup_lines(docs, drop_empty=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of the benchmark; a document that is little else goes."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, begin and end included, and the text that they decode to."""
    return encode_texts(docs, PIECES).withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("tokens", tokens)]

#: The classifier, the groups of near copies and the vocabulary are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
