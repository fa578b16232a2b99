"""Run registered queries against their SQL on the same tables and compare values.

usage: python tools/crosscheck.py [folder] [name-part ...]

EXACT=1 compares floating point values to the last digit instead of six digits.
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and os.environ.get("EXACT"):
        return repr(value)
    if isinstance(value, float):
        return f"{value:.6g}" if abs(value) >= 1e-9 else "0"
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, entry, folder, names=()):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, build in queries.items():
        if names and not any(part in name for part in names):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as exc:
            bad.append(name)
            print(f"ERROR {name}: {' '.join(str(exc)[:700].split())}")
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows  {took:.1f}s  (no SQL)")
            continue
        try:
            res = con.execute(oracle[name])
            cols = [d[0] for d in res.description]
            want = res.fetchall()
        except Exception as exc:
            bad.append(name)
            print(f"SQLERR {name}: {' '.join(str(exc)[:300].split())}")
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        same = sorted(df.columns) == sorted(cols) and a == b
        note = "" if same else "  MISMATCH"
        if not got:
            note += "  EMPTY"
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)}/{len(want)} rows {took:.1f}s{note}")
        if not same:
            bad.append(name)
            print("   columns", sorted(df.columns), sorted(cols) if sorted(df.columns) != sorted(cols) else "")
            sa, sb = set(a), set(b)
            for r in sorted(sa - sb)[:4]:
                print("   spark ", r)
            for r in sorted(sb - sa)[:4]:
                print("   sql   ", r)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    from ledgerloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(
        "crosscheck", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                     "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    compare(spark, importlib.import_module("__spark_entry__"), folder, sys.argv[2:])
