"""Compares registered queries with their SQL in DuckDB on one data folder.

    python tests/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, run, sql, sf_dir):
    start = time.time()
    df = run(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "rows-only", sum(got.values()), took, ""
    rel = con.execute(sql)
    ecols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if cols != ecols:
        return "COLUMNS", sum(got.values()), took, f"{cols} != {ecols}"
    if got != want:
        extra, lack = list((got - want).items())[:2], list((want - got).items())[:2]
        return "DIFF", sum(got.values()), took, f"{cols} n={sum(got.values())}/{sum(want.values())} differing={sum((got - want).values())} spark={extra} sql={lack}"
    return "ok", sum(got.values()), took, ""


def main():
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from ledgerline import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session()
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad, times = [], []
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) if w.endswith("_") else w in name for w in wanted):
            continue
        try:
            status, n, took, note = check(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001  (report and go on)
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        times.append((took, name))
        if status not in ("ok", "rows-only") or n == 0:
            bad.append(name)
            print(f"{status:10} {name} rows={n} {took:.1f}s {note[:1200]}", flush=True)
    print(f"{len(times)} queries, {len(bad)} bad: {bad}")
    print("slowest:", [(f"{t:.1f}", n) for t, n in sorted(times, reverse=True)[:12]], "total", round(sum(t for t, _ in times), 1))


if __name__ == "__main__":
    main()
