"""Holds a DataFrame against SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    answer = con.sql(sql)
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in places) for r in answer.fetchall())
