"""Run every registered query on Spark and its oracle SQL on DuckDB; compare results.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from steerclust.plans.registry import oracle_sql, queries
from steerclust.sources.tables import TABLES
from steerclust.session import local_session


STRICT = os.environ.get("STRICT") == "1"


def norm_val(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm_val(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_val(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s) [no oracle]")
            continue
        try:
            rel = con.execute(sql)
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        ok_v = ok_cols and ok_n and rows_of(scols, srows) == rows_of(dcols, drows)
        status = "ok  " if ok_v else "FAIL"
        if not ok_v:
            bad += 1
        print(f"{status} {name}: spark {len(srows)} rows, oracle {len(drows)} rows ({ts:.1f}s)"
              + ("" if ok_cols else f" cols {sorted(scols)} vs {sorted(dcols)}"))
        if ok_cols and ok_n and not ok_v:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diffs:
                print("   spark :", x)
                print("   oracle:", y)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
