"""Compare a Spark result with a checking statement run by DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        connection.execute(f"create view {table} as select * from read_parquet('{path}')")
    return connection


def rows_of(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(repr(row) for row in zip(*columns, strict=True))


def kinds_of(table: pa.Table) -> dict[str, str]:
    """Column types, with spellings that mean the same made equal."""
    same = {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}
    out = {}
    for f in table.schema:
        name = str(f.type)
        out[f.name] = same.get(name, name)
    return out


def differences(found: pa.Table, expected: pa.Table) -> str | None:
    if sorted(found.column_names) != sorted(expected.column_names):
        return f"columns {sorted(found.column_names)} != {sorted(expected.column_names)}"
    if kinds_of(found) != kinds_of(expected):
        return f"types {kinds_of(found)} != {kinds_of(expected)}"
    a, b = rows_of(found), rows_of(expected)
    if a != b:
        return f"rows differ: only Spark {list((a - b).items())[:5]}, only SQL {list((b - a).items())[:5]}"
    return None
