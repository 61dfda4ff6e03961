"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from memspark.plans.views import BASE_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    return x


def _norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, q) -> tuple[bool, str]:
    t0 = time.time()
    df = q(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if q.sql is None:
        return True, f"rows only: {len(got)} ({t1 - t0:.1f}s)"
    rel = con.execute(q.oracle())
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    info = f"{len(got)} rows, spark {t1 - t0:.1f}s, duckdb {time.time() - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _norm(df.columns, got), _norm(names, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        only = [sorted(sa - sb)[:2], sorted(sb - sa)[:2]]
        return False, f"{info}; want {len(want)}; only spark {len(sa - sb)}, only sql {len(sb - sa)}: {str(only)[:1500]}"
    return True, info


if __name__ == "__main__":
    from memspark.plans import load_registry
    from memspark.runtime import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for name, q in load_registry().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            ok, info = compare(spark, con, sf, name, q)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, info, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
