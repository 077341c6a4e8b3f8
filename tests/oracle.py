"""Comparing a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return Counter(tuple(norm(r[k]) for k in order) for r in data)


def compare(df, c, sql: str) -> tuple[bool, str]:
    got = df.collect()
    rel = c.sql(sql)
    a, b = rows(df.columns, got), rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    return a == b, f"{sum(a.values())} rows, {sum(b.values())} in SQL, e.g. {list((a - b).items())[:2]} {list((b - a).items())[:2]}"
