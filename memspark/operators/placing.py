"""Places in an order and next values, without a window over the rows of a group.

Rows are sorted into ranges; each range is read once with what the row before left behind, and one or two rows for each
range carry the rest across. A group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from memspark.runtime import cut_lineage

Batches = Iterator[pa.RecordBatch]


def _schema(df: DataFrame, *added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *added])


def _runs(column: pa.Array) -> tuple[np.ndarray, list]:
    """Where runs of equal values start, and their values."""
    coded = pc.dictionary_encode(column)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
    return starts, [coded.dictionary[int(c)].as_py() for c in codes[starts]]


def _sorted(rows: DataFrame, by: str, order: list[Column], run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    ranges = [F.col(by).asc(), *order]
    return cut_lineage(rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges).mapInArrow(run, schema))


def _number(at: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            starts, names = _runs(batch.column(at))
            place = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
            if names[0] == last:
                place[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = names[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])

    return run


def rank_rows(rows: DataFrame, by: str, order: list[str], name: str = "pos") -> DataFrame:
    """The row's place, from 0, in the order of its group; ``by`` has no nulls and ``order`` tells all rows apart."""
    placed = _sorted(rows, by, [F.col(c).asc() for c in order], _number(rows.columns.index(by)), _schema(rows, "part int", "place bigint"))
    counts = placed.groupBy(by, "part").agg(F.count("*").alias("n"))
    # A group has one row for each range here.
    before = counts.selectExpr(by, "part", f"coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    return placed.join(before, [by, "part"]).withColumn(name, F.col("place") + F.col("before")).select(*rows.columns, name)


ROW, FIRST, LAST = 0, 1, 2


def _fill(at: int, values: list[int], names: list[str]) -> Callable[[Batches], Batches]:
    """For each row the value that the rows before it left in its group; a range's first group, where nothing was left yet
    (``open``), may have more in the range before."""

    def run(batches: Batches) -> Batches:
        part, last, left, head = TaskContext.get().partitionId(), None, None, True
        blank = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            if left is None:
                left = [pa.nulls(1, batch.column(v).type) for v in values]
                blank = [pa.nulls(1, c.type) for c in batch.columns]
                yield _mark(batch, blank, at, batch.column(at).slice(0, 1), left, part, FIRST)
            starts, groups = _runs(batch.column(at))
            begin = np.repeat(starts, np.diff(starts, append=n))
            goes_on = last is not None and groups[0] == last
            head = head and (last is None or goes_on)
            if not goes_on:
                left = [pa.nulls(1, x.type) for x in left]
            found, open_ = [], np.zeros(n, dtype=bool)
            for k, v in enumerate(values):
                column = batch.column(v)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                seen = np.maximum.accumulate(np.where(valid, np.arange(n), -1))
                before = np.concatenate([[-1], seen[:-1]])
                # 0 is what earlier batches left; null for groups that begin here.
                take = np.where(before >= begin, before + 1, np.where(begin == 0, 0, -1))
                pool = pa.concat_arrays([left[k], column])
                found.append(pool.take(pa.array(take, mask=take < 0)))
                if head:
                    first = starts[1] if len(starts) > 1 else n
                    open_[:first] |= ~found[-1].is_valid().to_numpy(zero_copy_only=False)[:first]
                end = int(seen[-1])
                left[k] = pool.slice(end + 1, 1) if end >= starts[-1] else left[k] if len(starts) == 1 else pa.nulls(1, column.type)
            head = head and len(starts) == 1
            last = groups[-1]
            tail = batch.column(at).slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found, pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, ROW), pa.int32()), pa.array(open_)],
                names=[*batch.schema.names, *names, "part", "mark", "open"],
            )
        if left is not None:
            yield _mark(batch, blank, at, tail, left, part, LAST)

    def _mark(batch, blank, at, group, left, part, kind):
        columns = [*blank[:at], group, *blank[at + 1 :]]
        return pa.RecordBatch.from_arrays(
            [*columns, *left, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([False])], names=[*batch.schema.names, *names, "part", "mark", "open"]
        )

    return run


def next_values(rows: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """``next_<value>`` for each value: that of the next row of the group, in the order given, which has one."""
    names, kinds = [f"next_{v}" for v in values], dict(rows.dtypes)
    added = [f"`{n}` {kinds[v]}" for n, v in zip(names, values)]
    run = _fill(rows.columns.index(by), [rows.columns.index(v) for v in values], names)
    filled = _sorted(rows, by, [F.col(c).desc() for c in order], run, _schema(rows, *added, "part int", "mark int", "open boolean"))
    carried = [f"last({n}, true) OVER (PARTITION BY {by} ORDER BY part, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS `c_{n}`" for n in names]
    # Two rows for each range.
    carries = filled.where(F.col("mark") != ROW).selectExpr(by, "part", "mark", *carried).where(F.col("mark") == FIRST).drop("mark").withColumn("open", F.lit(True))
    kept = filled.where(F.col("mark") == ROW).join(carries, [by, "part", "open"], "left")
    return kept.select(*rows.columns, *[F.coalesce(n, f"c_{n}").alias(n) for n in names])
