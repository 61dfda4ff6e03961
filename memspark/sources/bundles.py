"""Export, import, snapshots and peer merge of project data as folders of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.operators.ranking import with_project

MANIFEST = "_manifest"


def select_bundle(tables: dict[str, DataFrame], project: str | None = None) -> dict[str, DataFrame]:
    """Rows of a project; of observations only the compressed ones."""
    out = {}
    for name, df in tables.items():
        df = with_project(df, project)
        out[name] = df.filter("compressed") if name == "observations" else df
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def export_bundle(tables: dict[str, DataFrame], path: str, project: str | None = None, fmt: str = "parquet") -> None:
    chosen = select_bundle(tables, project)
    for name, df in chosen.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
    # Counted from what was written, so the manifest describes the bundle even if a source changes meanwhile.
    spark = next(iter(chosen.values())).sparkSession
    written = {name: spark.read.schema(df.schema).format(fmt).load(f"{path}/{name}") for name, df in chosen.items()}
    manifest(written).write.mode("overwrite").format(fmt).save(f"{path}/{MANIFEST}")


def read_bundle(spark: SparkSession, path: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(f"{path}/{n}") for n in names}


def insert_absent(local: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a new key are added, one per key."""
    new = incoming.dropDuplicates([key]).join(local.select(key), key, "left_anti")
    return local.unionByName(new, allowMissingColumns=True)


def import_bundle(local: dict[str, DataFrame], bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sessions and memories are inserted when absent; observations and patterns of a bundle are not restored."""
    out = dict(local)
    if "sessions" in bundle:
        s = bundle["sessions"].withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("completed")))
        out["sessions"] = insert_absent(local["sessions"], s)
    if "memories" in bundle:
        m = bundle["memories"].filter(F.coalesce("id", F.lit("")) != "")
        m = m.withColumn("tier", F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("semantic")))
        out["memories"] = insert_absent(local["memories"], m)
    return out


def create_snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str, project: str | None = None) -> None:
    """A bundle frozen under its id: one partition folder per table, read back by partition filter."""
    for name, df in select_bundle(tables, project).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")


def read_snapshot(spark: SparkSession, path: str, name: str, snapshot_id: str) -> DataFrame:
    df = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")
    return df.drop("snapshot_id")


#: Columns that say when a row came to be, the first that a table has counts.
TIME_COLUMNS = ("created_at", "started_at", "ts", "shared_at", "updated_at")


def merge_tables(local: dict[str, DataFrame], peer: dict[str, DataFrame], since=None, time_cols: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Insert what the peer has and we have not, only rows after ``since`` when given.

    ``time_cols`` names a table's time column where it isn't one of the usual; a table without any fails when ``since`` is given.
    """
    out = {}
    for name, df in local.items():
        incoming = peer.get(name)
        if incoming is not None and since is not None:
            time_col = (time_cols or {}).get(name) or next((c for c in TIME_COLUMNS if c in incoming.columns), None)
            if time_col is None:
                raise ValueError(f"table {name} has no time column for since")
            incoming = incoming.filter(F.col(time_col) > F.lit(since).cast("timestamp"))
        out[name] = insert_absent(df, incoming) if incoming is not None else df
    return out
