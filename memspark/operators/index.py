"""Keyword and vector indexes as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memspark.functions.text import query_terms, runs, stem, words
from memspark.runtime import cut_lineage


# The row that stands for a document itself has the empty term.
DOCUMENT = ""


@dataclass(frozen=True)
class KeywordIndex:
    """``rows(term, doc_id, project, doc_len, tf)``: the postings, and one row with an empty term per document.

    Postings carry the document length and project, so scoring needs no join with the documents; the document rows come
    out of the same pass over the texts, so counts and lengths cost no second one.
    """

    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.rows.filter(F.col("term") != DOCUMENT)

    @property
    def docs(self) -> DataFrame:
        return self.rows.filter(F.col("term") == DOCUMENT).select("doc_id", "project", "doc_len")


COLUMNS = ("term", "doc_id", "project", "doc_len", "tf")


def build_keyword_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", project_col: str | None = "project") -> KeywordIndex:
    project = F.coalesce(F.col(project_col), F.lit("")) if project_col else F.lit("")
    worded = docs.select(F.col(id_col).alias("doc_id"), project.alias("project"), words(F.col(text_col)).alias("words"))
    rows = (
        worded.select("doc_id", "project", F.size("words").alias("doc_len"), F.explode(F.concat("words", F.array(F.lit(DOCUMENT)))).alias("word"))
        .select("doc_id", "project", "doc_len", stem(F.col("word")).alias("term"))
        .groupBy("term", "doc_id", "project", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return KeywordIndex(rows.select(*COLUMNS))


def index_unique(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Index rows of documents that have one row each, with the carried columns. Words are counted within the row, so no task
    holds the terms of many documents."""
    worded = docs.select("doc_id", F.coalesce("project", F.lit("")).alias("project"), words(F.col("text")).alias("words"), *carried)
    terms = F.transform("words", lambda w: stem(w))
    counted = worded.select("doc_id", "project", F.size("words").alias("doc_len"), F.concat(terms, F.array(F.lit(DOCUMENT))).alias("terms"), *carried)
    rows = counted.select("doc_id", "project", "doc_len", F.explode(runs(F.col("terms"))).alias("t"), *carried)
    return rows.select(F.col("t.item").alias("term"), "doc_id", "project", "doc_len", F.col("t.n").alias("tf"), *carried)


def mean_length(total: Column, count: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, 1.0).otherwise(total / count)


def corpus_stats(index: KeywordIndex) -> DataFrame:
    """Document count and average length (1 when nothing has a length), over all projects."""
    docs = index.docs.agg(F.count(F.lit(1)).alias("total_docs"), F.sum("doc_len").alias("n"))
    return docs.select("total_docs", mean_length(F.col("n"), F.col("total_docs")).alias("avg_doc_len"))


def term_frequencies(index: KeywordIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


TERM_BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_keyword_index(index: KeywordIndex, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Persist an index. Postings are laid out by term bucket; ``read_for_queries`` reads only the buckets of the queries' terms."""
    index = KeywordIndex(cut_lineage(index.rows))  # the texts are read and cut once for both tables
    bucketed = index.postings.withColumn("bucket", _bucket(buckets))
    # The document hash spreads a bucket that holds a very common term over several files and tasks.
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    bucketed.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/postings"
    )
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def read_keyword_index(spark: SparkSession, path: str) -> KeywordIndex:
    postings = spark.read.parquet(f"{path}/postings").select(*COLUMNS)
    docs = spark.read.parquet(f"{path}/docs")
    return from_tables(postings, docs)


def read_for_queries(queries: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> KeywordIndex:
    """A stored index as far as the queries need it: the wanted buckets, at most ``buckets`` numbers, prune the folders."""
    spark = queries.sparkSession
    terms = queries.select(F.explode(query_terms(F.col("query"))).alias("term"))
    wanted = sorted(r[0] for r in terms.select(_bucket(buckets)).distinct().collect())
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(wanted)).select(*COLUMNS)
    return from_tables(postings, spark.read.parquet(f"{path}/docs"))


def from_tables(postings: DataFrame, docs: DataFrame) -> KeywordIndex:
    whole = docs.select(F.lit(DOCUMENT).alias("term"), "doc_id", "project", "doc_len", F.lit(1).cast("bigint").alias("tf"))
    return KeywordIndex(postings.select(*COLUMNS).unionByName(whole))


def upsert_keyword_index(index: KeywordIndex, changed: KeywordIndex) -> KeywordIndex:
    """Replace the changed documents, add the new ones."""
    kept = index.rows.join(changed.docs.select("doc_id"), "doc_id", "left_anti")
    return KeywordIndex(kept.select(*COLUMNS).unionByName(changed.rows))


def delete_documents(index: KeywordIndex, doc_ids: DataFrame) -> KeywordIndex:
    return KeywordIndex(index.rows.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS))


def upsert_vectors(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace vectors by document id; a row whose size differs from the table's fails the job."""
    size = F.coalesce(vectors.agg(F.min(F.size("embedding"))).scalar(), F.size("embedding"))
    checked = changed.withColumn(
        "embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit("vector dimension mismatch")))
    )
    return vectors.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(checked)
