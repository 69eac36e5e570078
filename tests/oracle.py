"""Run a registered query and its reference SQL side by side."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _key(row):
    return tuple((x is not None, str(type(x)), str(x)) for x in row)


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else a description of the first difference."""
    started = time.time()
    df = fn(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if os.environ.get("ORACLE_TIMES"):
        print(f"{name}: spark {took:.1f}s duckdb {time.time() - started - took:.1f}s rows {len(got[1])}")
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = list(set(got[1]) - set(want[1]))[:2]
        lack = list(set(want[1]) - set(got[1]))[:2]
        return f"rows {len(got[1])} != {len(want[1])}; only spark {extra}; only sql {lack}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{dict(zip(got[0], a))} != {dict(zip(want[0], b))}"
    return None
