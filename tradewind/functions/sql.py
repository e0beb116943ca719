"""Small helpers to apply expression text to frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(value: str) -> str:
    """String literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def array_of(values: Iterable[str]) -> str:
    """Array of string literals; the cast gives an empty array its type."""
    return f"CAST(array({', '.join(text(v) for v in values)}) AS ARRAY<STRING>)"


def named(expressions: Mapping[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in expressions.items()]


def add(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """All columns plus new ones; a new column may use those named before it."""
    return df.selectExpr("*", *named(expressions))


def replace(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """The same columns in the same order, some of them recomputed."""
    return df.selectExpr(*[f"{expressions[c]} AS {c}" if c in expressions else f"`{c}`" for c in df.columns])


def aggregate(df: DataFrame, keys: Sequence[str], expressions: Mapping[str, str]) -> DataFrame:
    """One row per key combination; without keys, one row."""
    return df.groupBy(*keys).agg(*[F.expr(sql) for sql in named(expressions)])


def long_form(totals: DataFrame, rows: Iterable[Mapping[str, str]]) -> DataFrame:
    """A one-row frame as several rows, each given as column name -> expression."""
    structs = [f"named_struct({', '.join(f'{text(n)}, {sql}' for n, sql in row.items())})" for row in rows]
    return totals.selectExpr(f"inline(array({', '.join(structs)}))")
