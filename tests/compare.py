"""Compares registered queries with their SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in data), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    out = con.execute(sql)
    names = [x[0] for x in out.description]
    theirs = rows(names, out.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
        return f"{len(mine)} and {len(theirs)} rows; {odd}"[:600]
    return None
