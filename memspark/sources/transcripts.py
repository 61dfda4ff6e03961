"""Import of agent transcripts, JSON lines with tool calls and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with line numbers from 0, read in parallel also within one large file.

    Spark reads a file in byte ranges. Lines are numbered inside their range, ranges are counted, and a running sum over
    the few ranges of a file gives each range its first line number.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )
    ranges = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(offsets, ["file", "start"]).select("file", (F.col("row") - F.col("first") + F.col("offset")).alias("line_no"), "value")


def import_transcript(lines: DataFrame, project: str, session_id: str, now, existing: DataFrame | None = None) -> DataFrame:
    """Lines of type tool_use or tool_result -> raw observations; ids already in ``existing`` are left out.

    ``lines(line_no, value)`` may carry a ``file``. Lines of several files have the file's hash in their ids, so equal line
    numbers stay apart; without a file the line number alone names a line.
    """
    place = F.col("line_no").cast("string")
    if "file" in lines.columns:
        place = F.concat(F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 8), F.lit("-"), place)
    v = F.try_parse_json(F.trim("value"))
    kept = lines.filter(F.try_variant_get(v, "$.type", "string").isin("tool_use", "tool_result"))
    start = F.unix_micros(F.lit(now).cast("timestamp"))
    rows = kept.select(
        F.concat(F.lit(f"imp-{session_id[:8]}-"), place).alias("id"), F.lit(session_id).alias("session_id"),
        F.lit(project).alias("project"), F.lit("import").alias("hook_type"), F.to_json(v).alias("raw"), F.lit(False).alias("compressed"),
        F.timestamp_micros(start + F.col("line_no") * 1000).alias("created_at"),
    )
    return rows.join(existing.select("id"), "id", "left_anti") if existing is not None else rows
