"""Runs a registered query and its SQL over the same tables and compares the rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(directory) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_side(df: DataFrame):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_side(connection, sql: str):
    cursor = connection.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df: DataFrame, connection, sql: str) -> list[str]:
    expected = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    actual = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n}: {expected.get(n)} / {actual.get(n)}" for n in sorted({*expected, *actual}) if expected.get(n) != actual.get(n)]
