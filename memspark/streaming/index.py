"""Keyword index kept current by a stream of observations and deletions, as segments that are merged by size.

Every micro-batch is a segment, a folder named by checkpoint and batch. A deletion is a tombstone: a row for the document
itself that says so. What holds for a document is its newest row by ``ts``, of equal times the later version's, so a
batch that comes again, before or after its segment was merged, changes nothing. Segments of one size class are merged
once there are enough of them, so a row is written again once for each class and not for each batch; tombstones stay, as
an older text may still come.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.operators.index import COLUMNS, DOCUMENT, KeywordIndex, index_unique

#: Segments of a size class that are merged, and the ratio of one class's documents to the next's.
FACTOR = 4


def write_segment(docs: DataFrame, version: str, path: str) -> None:
    """Index the documents of one micro-batch, ``docs(doc_id, project, text, ts[, deleted])``, as a new version; a repeated
    batch overwrites its own folder only. Of several rows of a document the last counts, of equal times a deletion."""
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in docs.columns else F.lit(False)
    latest = docs.groupBy("doc_id").agg(F.max(F.struct("ts", gone.alias("deleted"), "project", "text")).alias("l")).select("doc_id", "l.*")
    # A deleted document has no words, so its only row is the one for itself.
    rows = index_unique(latest.withColumn("text", F.when(F.col("deleted"), "").otherwise(F.col("text"))), ["ts", "deleted"])
    rows.write.mode("overwrite").parquet(f"{path}/rows/version={version}")


def index_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """``docs(doc_id, project, text, ts[, deleted])`` -> versioned index folders.

    A version is named by the stream's checkpoint and the batch, so another checkpoint, or a compacted folder, is never overwritten.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = docs.writeStream.foreachBatch(lambda df, epoch: write_segment(df, f"{run}-{epoch:012d}", path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _segments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rows = rows.withColumn("version", F.col("version").cast("string"))
    return rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))


def _newest(rows: DataFrame) -> DataFrame:
    """Index rows of every document's newest version, tombstones included."""
    newest = rows.filter(F.col("term") == DOCUMENT).groupBy("doc_id").agg(F.max(F.struct("ts", "version")).alias("l")).select("doc_id", "l.version")
    # One row for each document is held by hash, so the postings need no sort.
    return rows.join(newest.hint("shuffle_hash"), ["doc_id", "version"]).drop("version")


def current_index(spark: SparkSession, path: str) -> KeywordIndex:
    """The newest version of every document that isn't deleted."""
    return KeywordIndex(_newest(_segments(spark, path)).filter(~F.coalesce("deleted", F.lit(False))).select(*COLUMNS))


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest versions as one version of a fresh folder, with their times, so that streams may go on into it."""
    _newest(_segments(spark, path)).write.mode("overwrite").parquet(f"{target}/rows/version=compacted")


def merge_segments(spark: SparkSession, path: str, factor: int = FACTOR) -> list[str]:
    """Merge each size class that has ``factor`` segments or more into one segment; the names of those merged.

    The driver sees a row for each segment. The merged one is written before its parts go; a reader or a crash in between
    finds both, which are equal.
    """
    rows = _segments(spark, path)
    sizes = rows.filter(F.col("term") == DOCUMENT).groupBy("version").agg(F.count(F.lit(1)).alias("n")).collect()
    classes: dict[int, list[str]] = {}
    for r in sizes:
        size, tier = r.n, 0
        while size >= factor:
            size, tier = size // factor, tier + 1
        classes.setdefault(tier, []).append(r.version)
    merged = []
    for tier in sorted(classes):
        parts = sorted(classes[tier])
        if len(parts) < factor:
            continue
        # The last part's name goes in front, so that among equal times the merged one stands where its last part stood.
        name = f"{parts[-1]}-m{hashlib.sha256(' '.join(parts).encode()).hexdigest()[:12]}"
        _newest(rows.filter(F.col("version").isin(parts))).write.mode("overwrite").parquet(f"{path}/rows/version={name}")
        for part in parts:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/version={part}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        merged += parts
    return merged
