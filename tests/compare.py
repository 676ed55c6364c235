"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os
from typing import Any

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem".split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value: Any) -> Any:
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()[:10]
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, bool):
        return int(value)
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    plain = [
        tuple(repr(float(v)) if isinstance(v, int) else v for v in row) for row in plain
    ]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs first."""
    result = connection.execute(sql)
    their_columns = [c[0] for c in result.description]
    theirs = _rows(their_columns, result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(their_columns):
        return f"columns {sorted(df.columns)} against {sorted(their_columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        a, b = different[0]
        cells = [
            (c, x, y) for c, x, y in zip(sorted(df.columns), a, b) if x != y
        ]
        return f"{len(different)} of {len(ours)} rows differ, first in {cells[:4]}"
    return None
