"""Runs a query in Spark and its SQL in DuckDB and compares rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def assert_same(spark, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
