"""Hook-event source: the same typed schema for files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

HOOK_SCHEMA = T.StructType(
    [
        T.StructField("hookType", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data", T.StringType()),
    ]
)
KNOWN_FIELDS = tuple(f.name for f in HOOK_SCHEMA)


def parse_hook_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines -> hook columns and ``parse_error`` (bad JSON, unknown fields)."""
    v = F.try_parse_json(F.col(col))
    keys = F.json_object_keys(F.col(col))
    unknown = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in KNOWN_FIELDS]))
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return lines.select(
        get("$.hookType").alias("hook_type"), get("$.sessionId").alias("session_id"), F.coalesce(get("$.project"), F.lit("")).alias("project"),
        F.coalesce(get("$.cwd"), F.lit("")).alias("cwd"), F.try_to_timestamp(get("$.timestamp")).alias("ts"),
        F.to_json(F.try_variant_get(v, "$.data", "variant")).alias("data"),
        F.when(v.isNull(), "invalid JSON").when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.get(unknown, F.lit(0)))).alias("parse_error"),
    )


def read_hooks(spark: SparkSession, path: str) -> DataFrame:
    return parse_hook_lines(spark.read.text(path))


def stream_hooks(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Hook events as they come; a micro-batch takes a bounded number of files, so that no key's rows of one batch grow without bound."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
    return parse_hook_lines(reader.load(path))
