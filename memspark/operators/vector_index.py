"""A stored vector index: cells of similar vectors, searched exactly by bounds on their angles.

Every vector lies in the folder of its nearest centre. A table of cells has each centre, the largest angle of its vectors
to it, and their number; a table of one row has the model and the size of all vectors, and a second model or size is
refused. A query searches the nearest cells that hold enough vectors for a full list, and then every cell that may still
hold one at least as good as its last hit: no vector of a cell is nearer than the angle to the centre less the radius.
Only the folders that some query needs are read, and of these only blocks whose angles to the centre may fit.

Centres are found on a bounded sample; all vectors are stored, and the search is exact whatever the centres are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memspark.operators.search import DOCUMENT_BLOCK, QUERY_BLOCK, _unit, ranked, score_tiles
from memspark.runtime import cut_lineage

#: The sample that centres are fitted on: so many vectors, and so many numbers in all.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 8_000_000
MAX_CELLS = 1024
CELL_ROWS = 4096
ROUNDS = 8
#: Angles are good to this.
MARGIN = 1e-6
NONE = -2.0  # below any score


@dataclass(frozen=True)
class Cells:
    """Centres as unit rows, one zero row last for vectors without direction; radii and numbers of vectors."""

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; the sample's order decides where it starts."""
    unit = _unit(sample)
    unit = np.unique(unit[np.abs(unit).sum(axis=1) > 0].round(12), axis=0)
    if not len(unit):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, unit)
        moved = _unit(total)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), size)


def _assigned(vectors: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """With the nearest cell and the angle to its centre; vectors of another size fail the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            if (batch["embedding"].map(len) != size).any():
                raise ValueError(f"the index holds vectors of size {size} only")
            unit = _unit(_matrix(batch["embedding"], size))
            flat = np.abs(unit).sum(axis=1) == 0
            near = unit @ centres[:-1].T if len(centres) > 1 else np.zeros((len(unit), 0))
            cell = np.where(flat, len(centres) - 1, near.argmax(axis=1) if near.shape[1] else len(centres) - 1)
            best = near.max(axis=1) if near.shape[1] else np.zeros(len(unit))
            angle = np.where(flat, np.pi, np.arccos(np.clip(best, -1.0, 1.0)))
            yield batch.assign(cell=cell.astype(np.int32), angle=angle)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInPandas(run, f"{fields}, cell int, angle double")


def _slim(vectors: DataFrame) -> DataFrame:
    project = F.coalesce("project", F.lit("")).alias("project")
    return vectors.select("doc_id", project, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") > 0)


def _write_rows(rows: DataFrame, path: str, mode: str) -> None:
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    writer = rows.repartition("cell", spread).sortWithinPartitions("cell", "angle").write.partitionBy("cell")
    writer.mode("overwrite").option("partitionOverwriteMode", mode).parquet(f"{path}/vectors")


def _write_cells(spark: SparkSession, path: str, centres: np.ndarray, version: int) -> None:
    """Radius and rows of every cell, from the stored angles."""
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    seen = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    table.join(seen, "cell", "left").fillna(0, ["radius", "n"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/version={version}")


def write_vector_index(vectors: DataFrame, path: str, model: str, cells: int | None = None) -> None:
    """Store ``vectors(doc_id, project, embedding)`` of one model. Empty and null vectors are left out."""
    spark, slim = vectors.sparkSession, _slim(vectors)
    first = slim.select(F.size("embedding").alias("size")).agg(F.min("size"), F.count("*")).first()
    size, count = first[0] or 0, first[1]
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(size, 1)))
    sample = slim.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("embedding").toPandas()["embedding"] if size else []
    sample = np.array([np.asarray(x, np.float64) for x in sample if len(x) == size]).reshape(-1, size)
    centres = fit_centres(sample, min(MAX_CELLS, cells or max(1, -(-count // CELL_ROWS))))
    centres = np.concatenate([centres.reshape(-1, size), np.zeros((1, size))])
    _write_rows(_assigned(slim, centres, size), path, "static")
    _write_cells(spark, path, centres, 0)
    spark.createDataFrame([(model, size)], "model string, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _about(spark: SparkSession, path: str, model: str) -> int:
    known = spark.read.parquet(f"{path}/about").first()
    if known.model != model:
        raise ValueError(f"the index holds vectors of model {known.model}, not {model}")
    return known.size


def read_cells(spark: SparkSession, path: str) -> tuple[int, Cells]:
    """The newest table of cells, at most MAX_CELLS rows and one."""
    table = spark.read.parquet(f"{path}/cells")
    version = table.agg(F.max("version")).first()[0]
    rows = sorted(table.filter(F.col("version") == version).collect(), key=lambda r: r.cell)
    return version, Cells(np.array([r.centre for r in rows], dtype=np.float64).reshape(len(rows), -1), np.array([r.radius for r in rows]), np.array([r.n for r in rows]))


def read_vectors(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(wanted))


def _visits(queries: DataFrame, cells: Cells, size: int, limit: int, near: bool) -> DataFrame:
    """(query, cell, low, high): the cells to search, with the angles to the centre that hits may have.

    ``near``: the nearest cells with vectors enough for a full list. Else all others that may hold better than ``bar``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            if (batch["embedding"].map(len) != size).any():
                raise ValueError(f"the index holds vectors of size {size} only")
            unit = _unit(_matrix(batch["embedding"], size))
            angle = cells.angles(unit)
            angle[:, -1] = 0.0  # vectors without direction score 0 with any query
            angle[np.abs(unit).sum(axis=1) == 0] = 0.0  # and so does a query without one
            open_ = np.maximum(angle - cells.radius - MARGIN, 0.0)
            order = np.lexsort((np.broadcast_to(np.arange(len(cells.rows)), angle.shape), angle), axis=1)
            before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
            first = np.zeros(angle.shape, dtype=bool)
            np.put_along_axis(first, order, before < limit, axis=1)
            if near:
                chosen, slack = first, np.full(angle.shape, np.pi)
            else:
                bar = batch["bar"].to_numpy()[:, None]
                chosen = ~first & (np.cos(open_) + MARGIN >= bar)
                slack = np.broadcast_to(np.arccos(np.clip(bar, -1.0, 1.0)) + np.sqrt(MARGIN), angle.shape).copy()
                slack[np.abs(unit).sum(axis=1) == 0] = np.pi
                slack[:, -1] = np.pi
            chosen = chosen & (cells.rows > 0)
            q, c = np.nonzero(chosen)
            if len(q):
                yield batch[["query_id", "project", "embedding"]].iloc[q].assign(cell=c.astype(np.int32), low=(angle - slack)[q, c], high=(angle + slack)[q, c])

    kind = dict(queries.dtypes)["query_id"]
    return queries.mapInPandas(run, f"query_id {kind}, project string, embedding array<double>, cell int, low double, high double")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stored rows, which lie by cell and angle, as blocks of one cell."""
    for batch in batches:
        for cell, part in batch.groupby("cell"):
            for start in range(0, len(part), DOCUMENT_BLOCK):
                rows = part.iloc[start : start + DOCUMENT_BLOCK]
                packed = np.concatenate([np.asarray(x, np.float64) for x in rows["embedding"]]).tobytes()
                yield pd.DataFrame({"cell": [cell], "ids": [rows["doc_id"].to_list()], "projects": [rows["project"].to_list()], "packed": [packed], "least": [rows["angle"].min()], "most": [rows["angle"].max()]})


def _search(visits: DataFrame, path: str, limit: int) -> DataFrame:
    spark = visits.sparkSession
    visits = cut_lineage(visits)
    wanted = [r.cell for r in visits.select("cell").distinct().collect()]  # at most the number of cells
    stored = read_vectors(spark, path, wanted)
    kind = dict(stored.dtypes)["doc_id"]
    blocks = stored.mapInPandas(_blocks, f"cell int, ids array<{kind}>, projects array<string>, packed binary, least double, most double")
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(W.partitionBy("cell", "lane").orderBy("low", "query_id"))
    # Lanes bound what is numbered together.
    placed = visits.withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(lanes))).withColumn("block", F.floor((place - 1) / QUERY_BLOCK))
    asked = placed.groupBy("cell", "lane", "block").agg(
        F.collect_list(F.struct("query_id", "project", "embedding")).alias("queries"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    tiles = blocks.join(asked, "cell").filter("most >= low AND least <= high").select("ids", "projects", "packed", "queries")
    return ranked(score_tiles(tiles, limit, visits.schema["query_id"].dataType, stored.schema["doc_id"].dataType), limit)


def search_stored_vectors(query_vectors: DataFrame, path: str, model: str, limit: int = 10) -> DataFrame:
    """Exact cosine top-k in a stored index. ``query_vectors(query_id, project, embedding)`` of the index's model and size."""
    spark = query_vectors.sparkSession
    size = _about(spark, path, model)
    _, cells = read_cells(spark, path)
    queries = query_vectors.select("query_id", F.coalesce("project", F.lit("")).alias("project"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.filter(F.size("embedding") > 0)
    first = cut_lineage(_search(_visits(queries, cells, size, limit, True), path, limit))
    bars = first.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("score")).otherwise(NONE).alias("bar"))
    more = _visits(queries.join(bars, "query_id", "left").fillna(NONE, ["bar"]), cells, size, limit, False)
    found = first.select("query_id", "doc_id", "score").unionByName(_search(more, path, limit).select("query_id", "doc_id", "score"))
    return ranked(found, limit)


def change_vector_index(spark: SparkSession, path: str, model: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """Replace and add ``changed(doc_id, project, embedding)`` and leave out ``deleted(doc_id)``. Only folders that lose or
    get rows are written again. One writer at a time; a search while it runs may see old and new folders."""
    size = _about(spark, path, model)
    version, cells = read_cells(spark, path)
    stored = spark.read.parquet(f"{path}/vectors")
    new = cut_lineage(_assigned(_slim(changed), cells.centres, size)) if changed is not None else stored.limit(0)
    gone = [x.select(F.col("doc_id")) for x in (changed, deleted) if x is not None]
    ids = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
    ids = ids.distinct()
    touched = stored.join(ids, "doc_id", "left_semi").select("cell").union(new.select("cell")).distinct()
    wanted = [r.cell for r in touched.collect()]  # at most the number of cells
    kept = read_vectors(spark, path, wanted).join(ids, "doc_id", "left_anti")
    rows = kept.unionByName(new.join(deleted.select("doc_id"), "doc_id", "left_anti") if deleted is not None else new)
    rows = cut_lineage(rows)
    _empty_folders(spark, path, wanted, rows)
    _write_rows(rows, path, "dynamic")
    _write_cells(spark, path, cells.centres, version + 1)


def _empty_folders(spark: SparkSession, path: str, wanted: list[int], rows: DataFrame) -> None:
    """Folders that get no rows any more are not overwritten, so they are removed."""
    left = {r.cell for r in rows.select("cell").distinct().collect()}
    jvm = spark.sparkContext._jvm
    for cell in set(wanted) - left:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/vectors/cell={cell}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
