"""Run named queries on Spark and their SQL twins on DuckDB and compare the results as bags of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = bag(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    missing, extra = want - got, got - want
    return (f"rows {sum(got.values())} vs {sum(want.values())}; missing {sum(missing.values())} "
            f"e.g. {list(missing)[:2]}; extra {sum(extra.values())} e.g. {list(extra)[:2]} (columns {sorted(names)})")
