"""Spark's rows against DuckDB's on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return c


def plain(row, columns: list[str]) -> tuple:
    """A row in the order of the sorted column names, numbers to nine digits."""
    values = dict(zip(columns, row))
    return tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in (values[c] for c in sorted(columns)))


def spark_rows(df) -> list[tuple]:
    return sorted((plain(r, df.columns) for r in df.collect()), key=repr)


def duck_rows(connection, sql: str) -> list[tuple]:
    got = connection.sql(sql)
    return sorted((plain(r, got.columns) for r in got.fetchall()), key=repr)
