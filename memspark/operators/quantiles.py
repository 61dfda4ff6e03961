"""Quantiles from mergeable sketches, the same on tables and streams.

A value is counted in whole units in a bucket of its first eight binary digits, so a bucket is at most 1/128 of its values
wide and values under 128 have buckets of their own. A sketch is the counts of a group's buckets, at most 128 for each
power of two, whatever the number of rows; sketches are merged by adding counts. The quantile read from one is the upper
end of the bucket that holds the exact quantile: its rank is never lower, and it is less than 1/128 too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DIGITS = 8
LATE = "5 minutes"


def _bucket_end(units: Column) -> Column:
    """Upper end of a value's bucket."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(units)) - DIGITS, F.lit(0))).cast("bigint")
    return (F.floor(units / step) + 1) * step - 1


def sketch(rows: DataFrame, value: str, by: list[str], unit: float = 1e-6, width: str | None = None, ts: str = "ts", late: str = LATE) -> DataFrame:
    """(by, bucket, n), and window_start where a window's ``width`` is given. Values are rounded up to whole units; null and
    negative ones are left out. On a stream, windows close ``late`` after their end."""
    units = F.ceil(F.round(F.col(value) / F.lit(unit), 3)).cast("bigint")
    rows = rows.filter(F.col(value) >= 0)
    keys = [F.col(c) for c in by]
    if width is not None:
        if rows.isStreaming:
            rows = rows.withWatermark(ts, late)
        keys.append(F.window(ts, width).alias("w"))
    counted = rows.groupBy(*keys, _bucket_end(units).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, *([F.col("w.start").alias("window_start")] if width is not None else []), "bucket", "n")


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows that these were made of."""
    keys = [c for c in sketches[0].columns if c != "n"]
    return reduce(DataFrame.unionByName, sketches).groupBy(*keys).agg(F.sum("n").alias("n"))


def over_windows(made: DataFrame) -> DataFrame:
    """The sketch of all windows together."""
    return merge(made.drop("window_start"))


def percentiles(made: DataFrame, shares: tuple[int, ...] = (500, 950, 990), unit: float = 1e-6) -> DataFrame:
    """(by, n, p<share>) with shares in thousandths, by nearest rank, in the units of the values. A group here has a row
    for each bucket, not for each value."""
    keys = [c for c in made.columns if c not in ("bucket", "n")]
    group = W.partitionBy(*keys)
    summed = made.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    ends = [
        (F.min(F.when(F.col("up_to") >= F.greatest(F.expr(f"(all * {p} + 999) div 1000"), F.lit(1)), F.col("bucket"))) * F.lit(unit)).alias(f"p{p}") for p in shares
    ]
    return summed.groupBy(*keys).agg(F.sum("n").alias("n"), *ends)
