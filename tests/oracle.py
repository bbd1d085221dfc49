"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def by_name(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    found = views(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(found.columns, found.fetchall())
