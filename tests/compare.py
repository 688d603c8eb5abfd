"""Compare a Spark result with the rows DuckDB returns for the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if value != 0 else "0"
    if isinstance(value, decimal.Decimal):
        return f"D{value}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value if isinstance(value, (bool, int)) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def differences(df, con, sql: str) -> str | None:
    """None where both sides agree, else a description."""
    result = con.execute(sql)
    columns, expected = canonical([d[0] for d in result.description], result.fetchall())
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if columns != got_columns:
        return f"columns {got_columns} != {columns}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; first {got[:2]} / {expected[:2]}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    return None
