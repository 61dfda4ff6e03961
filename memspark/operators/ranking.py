"""Top-k per group that never brings a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Spark keeps the first k rows of a group already before the shuffle, up to this k.
NATIVE_GROUP_LIMIT = 1000


def top_per_group(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    k: int | None,
    rank_col: str = "rank",
    spread: Column | None = None,
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of each group by ``order``, ranked from 1; None ranks all.

    Small ``k``: the row_number filter lets Spark keep k rows per group and map task before the shuffle. Large ``k``:
    the group is first cut per salt (a hash of ``spread``), so a hot group is ranked by many tasks and at most
    ``k * salts`` of its rows meet in the last one.
    """
    final = W.partitionBy(*keys).orderBy(*order)
    if k is None:
        return df.withColumn(rank_col, F.row_number().over(final))
    if k > NATIVE_GROUP_LIMIT:
        if spread is None:
            raise ValueError("a large k needs the spread column that salts the groups")
        df = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        part = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= k).drop("__rn", "__salt")
    return df.withColumn(rank_col, F.row_number().over(final)).filter(F.col(rank_col) <= k)


def with_project(df: DataFrame, project: str | None, col: str = "project") -> DataFrame:
    """An optional project filter, added only when given so that it reaches the scan."""
    return df.filter(F.col(col) == project) if project else df
