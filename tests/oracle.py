"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return None if v is None or v != v else v


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(zip(*(map(plain, table.column(n).to_pylist()) for n in names), strict=True), key=repr)


def same(spark, con, query, sql: str, sf: str) -> None:
    got, want = query(spark, sf).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
