"""Runs registered queries next to their SQL in DuckDB and compares names, row counts and values.

Usage: python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in v.items())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, f"{DATA}/sf{sf}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), t1 - t0, 0.0, ""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    t2 = time.time()
    note = ""
    if sorted(names) != sorted(df.columns):
        note = f"columns {sorted(df.columns)} vs {sorted(names)}"
    elif len(got) != len(want):
        note = f"rows {len(got)} vs {len(want)}"
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        note = f"{len(bad)} rows differ, e.g. {bad[0]}"
    else:
        types = [(a, b) for g, w in zip(got[:50], want[:50]) for a, b in zip(g, w) if type(a) is not type(b)]
        note = f"types {types[:2]}" if types else ""
    return ("ok" if not note else "FAIL"), len(got), t1 - t0, t2 - t1, note


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from tests.conftest import build_session
    spark = build_session()
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            status, n, ts, td, note = compare(spark, con, name, fn, oracles.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            status, n, ts, td, note = "ERROR", 0, 0, 0, str(e).split("JVM stacktrace")[0][:400]
        failed += status in ("FAIL", "ERROR")
        if n == 0 and status != "ERROR":
            note += " EMPTY"
        print(f"{status:9} {name:36} rows={n:<7} spark={ts:6.2f}s duck={td:6.2f}s {note[:1500]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
