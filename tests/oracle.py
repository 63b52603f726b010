"""Holds a query against its DuckDB equivalent: rows, column names and values, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
            return round(float(v), 6)
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differs(spark, name, query, sql, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(sql)
    want_cols, want = [x[0] for x in cur.description], cur.fetchall()
    df = query(spark, sf)
    if sorted(df.columns) != sorted(want_cols):
        return f"{name}: columns {sorted(df.columns)} and {sorted(want_cols)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(want_cols, want)
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        return f"{name}: {len(got)} and {len(want)} rows, {pairs}"
    return ""
