"""Compares a query with its SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


def both(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[tuple], list[tuple]]:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
