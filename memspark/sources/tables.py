"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it is."""
    return spark.read.parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of few files over the partitions of a shuffle before heavy work on their texts: a file of one row group
    is one task. Tables of as many files as partitions are left as they are, so large tables are never moved."""
    wanted = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted) if len(df.inputFiles()) < wanted else df
