"""Side-by-side comparison of a query with its SQL, in the manner of the driver's check."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return ("decimal", float(v))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if names, and rows without regard to order, are the same."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        here, there = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows against {len(want)}; only here {sorted(here - there)[:2]}; only there {sorted(there - here)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} against {w}"
    return ""
