"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, con, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    theirs = rows([d[0] for d in con.description], con.fetchall())
    if mine == theirs:
        return None
    a, b = set(mine[1]), set(theirs[1])
    return f"columns {mine[0]} {theirs[0]}; rows {len(mine[1])} {len(theirs[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
