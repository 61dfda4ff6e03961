"""What several operators of this package need: reading, shared files, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memspark.runtime import ensure_checkpoint_dir

ArrowRows = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later jobs start from files and survive lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/memspark-llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes; None for null."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: ArrowRows, rows: int = 256) -> ArrowRows:
    """The same rows in smaller batches, which bounds what is held beside them when texts are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256) -> DataFrame:
    """Apply fn to small Arrow batches."""

    def run(batches: ArrowRows) -> ArrowRows:
        for batch in pieces(batches, rows):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
