"""Compares a query's rows with its SQL in DuckDB: names, row count and values, whatever the order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> list[str]:
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} against {want_names}"]
    out = []
    if sum(got.values()) != sum(want.values()):
        out.append(f"rows {sum(got.values())} against {sum(want.values())}")
    out += [f"only Spark: {r}" for r in list((got - want))[:3]] + [f"only SQL: {r}" for r in list((want - got))[:3]]
    return out
