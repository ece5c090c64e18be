"""Compares a registered query with its SQL the way an order-insensitive checker does."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (dt.date, dt.datetime)):
        return str(x)
    if hasattr(x, "is_finite"):
        return float(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str):
    """None when equal, else a short description."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; first {got[:1]} / {want[:1]}"
    kinds = lambda t: tuple(type(x).__name__ for x in t)
    for a, b in zip(got, want):
        if a != b:
            close = len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b))
            return f"{'CLOSE ' if close else ''}{a} != {b}"
        if kinds(a) != kinds(b):
            return f"types {kinds(a)} != {kinds(b)}"
    return None
