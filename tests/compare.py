"""Run registered queries against their SQL on the driver tables. ``python tests/compare.py [sf] [name part ...]``"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("claimgrid-tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return v
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf: str, queries, oracles) -> tuple[bool, str]:
    t = time.time()
    df = queries[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if name not in oracles:
        return True, f"rows only: {len(got)}"
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        in_got, in_want = set(got), set(want)
        extra, lost = [r for r in got if r not in in_want][:3], [r for r in want if r not in in_got][:3]
        kinds = ([type(x).__name__ for x in got[0]] if got else [], [type(x).__name__ for x in want[0]] if want else [])
        return False, f"{len(got)} vs {len(want)} rows; only here {extra}; only oracle {lost}; types {kinds}"
    return True, f"{len(got)} rows, spark {took:.1f}s"


def main() -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import oracle_sql, queries

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    want = sys.argv[2:]
    spark, con = session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    q, o, bad = queries(), oracle_sql(), 0
    for name in q:
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, name, sf, q, o)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:350]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note[:700]}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
