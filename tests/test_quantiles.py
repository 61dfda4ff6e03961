"""Quantile sketches: stated error, merging, streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memspark.operators import quantiles
from test_streaming import in_time_order, run, stream_of

BASE = dt.datetime(2024, 1, 1)


def rows_of(n=4000):
    rnd = random.Random(8)
    return [("a" if rnd.random() < 0.7 else "b", abs(rnd.lognormvariate(-5, 3)), BASE + dt.timedelta(seconds=i * 7)) for i in range(n)] + [
        ("c", 0.0, BASE), ("c", 0.000127, BASE), ("d", -1.0, BASE), ("d", None, BASE)
    ]


def exact(values, share):
    values = sorted(values)
    return values[max((len(values) * share + 999) // 1000, 1) - 1]


def test_error_is_as_stated(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "mode string, seconds double, ts timestamp").repartition(5)
    made = quantiles.sketch(df, "seconds", ["mode"])
    got = {r["mode"]: r for r in quantiles.percentiles(made, (1, 500, 950, 999, 1000)).collect()}
    assert set(got) == {"a", "b", "c"}  # nothing can be said of negative and null values
    for mode, r in got.items():
        values = [s for m, s, _ in rows if m == mode]
        assert r.n == len(values)
        for share in (1, 500, 950, 999, 1000):
            want, found = exact(values, share), r[f"p{share}"]
            assert want - 1e-9 <= found <= want * (1 + 1 / 128) + 1.000001e-6
            # So many values are at most the one found: the rank is never lower than asked for.
            assert sum(v <= found + 1e-9 for v in values) >= (len(values) * share + 999) // 1000
    assert made.groupBy("mode").count().agg(F.max("count")).first()[0] < 64 * 128


def test_merging_changes_nothing(spark):
    df = spark.createDataFrame(rows_of(), "mode string, seconds double, ts timestamp")
    whole = sorted(quantiles.sketch(df, "seconds", ["mode"]).collect())
    halves = [quantiles.sketch(df.filter(c), "seconds", ["mode"]) for c in ("seconds < 0.01", "NOT seconds < 0.01")]
    assert sorted(quantiles.merge(*halves).collect()) == whole
    assert sorted(quantiles.over_windows(quantiles.sketch(df, "seconds", ["mode"], width="1 hour")).collect()) == whole


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame(rows_of(), "mode string, seconds double, ts timestamp")
    path = str(tmp_path / "in")
    in_time_order(df, path)
    made = quantiles.sketch(stream_of(spark, path, df.schema), "seconds", ["mode"], width="1 hour")
    got = run(made, "latency_out", tmp_path, "update")
    last = got.groupBy("mode", "window_start", "bucket").agg(F.max("n").alias("n"))
    table = quantiles.percentiles(quantiles.sketch(df, "seconds", ["mode"], width="1 hour"))
    assert sorted(quantiles.percentiles(last).collect()) == sorted(table.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "mode string, seconds double, ts timestamp")
    assert quantiles.percentiles(quantiles.sketch(df, "seconds", ["mode"])).count() == 0
