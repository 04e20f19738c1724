"""Compares a Spark result with DuckDB's on the same tables."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _value(v):
    if v is None:
        return "null"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:.5f}"
    return str(v)


def rows_of(frame) -> list[tuple]:
    return sorted(tuple(_value(v) for v in row) for row in frame)


def assert_same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = [tuple(r[c] for c in order) for r in df.collect()]
    theirs = [tuple(r[names.index(c)] for c in order) for r in other]
    assert rows_of(mine) == rows_of(theirs)
