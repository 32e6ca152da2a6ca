"""Runs queries next to their SQL cross-checks and reports differences.

    python tests/oracle_check.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if value is None:
        return "∅"
    if hasattr(value, "asDict"):
        value = tuple(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 10**6 else str(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(canon(r[i]) for i in order) for r in rows)


def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    seconds = time.time() - t0
    if sql is None:
        return "rows-only", len(rows), seconds, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    expected = cur.fetchall()
    c1, r1 = table(df.columns, [tuple(r) for r in rows])
    c2, r2 = table(cols, expected)
    if c1 != c2:
        return "COLUMNS", len(rows), seconds, f"{c1} vs {c2}"
    if r1 != r2:
        a, b = set(r1), set(r2)
        detail = f"{len(r1)} vs {len(r2)} rows\n   spark only: {[x[:300] for x in sorted(a - b)[:3]]}\n   sql only:   {[x[:300] for x in sorted(b - a)[:3]]}"
        return "VALUES", len(rows), seconds, detail
    return "ok" if rows else "EMPTY", len(rows), seconds, ""


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from docsentry.plans import catalogue
    from docsentry.session import get_session

    spark = get_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, n, seconds, detail = compare(spark, con, args.sf, name, fn, catalogue.ORACLES.get(name))
        except Exception as exc:  # report and go on to the next query
            status, n, seconds, detail = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:36s} {n:7d} rows {seconds:6.2f}s {detail}", flush=True)
    print("failures:", bad)
    sys.stdout.flush()
    os._exit(1 if bad else 0)


if __name__ == "__main__":
    main()
