"""Rows of a Spark query against DuckDB's, in any order; doubles to nine significant digits."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return x if isinstance(x, (bool, int)) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def assert_same(spark_df, relation):
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(relation.columns, relation.fetchall())
