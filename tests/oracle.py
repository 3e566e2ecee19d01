"""Comparison of a query with its SQL, as the driver does it."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    columns = sorted(con.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {listed} FROM ({sql})").fetchall())


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, rows = expected(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == rows
