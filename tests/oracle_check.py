"""Runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=repr)


def compare(df, con, sql: str):
    """(number of rows, list of differences)."""
    got_names = df.columns
    got = _sorted_rows(got_names, df.collect())
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = _sorted_rows(want_names, result.fetchall())
    faults = []
    if sorted(got_names) != sorted(want_names):
        faults.append(f"columns {sorted(got_names)} != {sorted(want_names)}")
    if len(got) != len(want):
        faults.append(f"{len(got)} rows != {len(want)}")
    for g, w in zip(got, want):
        if g != w:
            faults.append(f"{str(g)[:600]}\n!= {str(w)[:600]}")
            break
    return len(got), faults
