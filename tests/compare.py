"""Holds a query's rows against its SQL's on DuckDB: names, counts and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, fn, sql):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = fn(spark, sf_dir)
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows_of(names, cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows, SQL has {len(b[1])}; only here {sorted(set(a[1]) - set(b[1]))[:3]}, only there {sorted(set(b[1]) - set(a[1]))[:3]}"
    if a[1] != b[1]:
        return f"only here {sorted(set(a[1]) - set(b[1]))[:3]}, only there {sorted(set(b[1]) - set(a[1]))[:3]}"
    if not a[1]:
        return "no rows"
    return ""
