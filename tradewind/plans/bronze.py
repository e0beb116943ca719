"""Bronze: raw rows plus where and when they came from, and a profile of what arrived."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from tradewind.functions.sql import aggregate, array_of, text
from tradewind.functions.text import record_hash, record_md5

# Source label and state of a freshly ingested row.
SOURCE_SYSTEM = "data_generation"
RAW_STATE = "raw"
METADATA_PREFIX = "bronze_"
NOW = "current_timestamp()"


def with_metadata(raw: DataFrame, table: str, ingested_at: str = NOW) -> DataFrame:
    """Raw columns plus ingestion time, source, row digests and a row id. One projection, no shuffle."""
    return raw.selectExpr(
        "*",
        f"CAST({ingested_at} AS TIMESTAMP) AS bronze_ingestion_timestamp",
        f"CAST({ingested_at} AS DATE) AS bronze_ingestion_date",
        f"{text(SOURCE_SYSTEM)} AS source_system",
        f"{text(table)} AS source_table",
        f"{text(RAW_STATE)} AS data_quality_status",
        f"{record_hash(raw.columns)} AS record_hash",
        f"{record_md5(raw.columns)} AS record_md5",
        "monotonically_increasing_id() AS bronze_record_id",
    )


def with_source_file(raw: DataFrame, table: str, ingested_at: str = NOW) -> DataFrame:
    """The short variant: ingestion time and a source label only."""
    return raw.selectExpr("*", f"CAST({ingested_at} AS TIMESTAMP) AS ingestion_timestamp", f"{text(table)} AS source_file")


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, null_count for every column that is not bronze metadata; one scan."""
    columns = [c for c in df.columns if not c.startswith(METADATA_PREFIX)]
    totals = aggregate(df, [], {f"`{c}`": f"count_if(`{c}` IS NULL)" for c in columns})
    pairs = ", ".join(f"{text(c)}, `{c}`" for c in columns)
    return totals.selectExpr(
        f"{text(table)} AS table_name", f"stack({len(columns)}, {pairs}) AS (column_name, null_count)"
    )


def null_metrics(columns: Sequence[str]) -> dict[str, str]:
    """name -> aggregate of the NULLs of each column, to be counted by the write of a table."""
    return {f"null_{i}": f"count_if(`{c}` IS NULL)" for i, c in enumerate(columns) if not c.startswith(METADATA_PREFIX)}


def nulls_of_counts(table: str, columns: Sequence[str], counts: Mapping[str, int]) -> list[tuple[str, str, int]]:
    """The rows of ``null_counts`` from what the write counted."""
    return [(table, c, int(counts[f"null_{i}"] or 0)) for i, c in enumerate(columns) if f"null_{i}" in counts]


def duplicate_count(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """table_name, record_count, distinct_count, duplicate_count over the key columns.

    Rows are counted per key before the shuffle, so a key with many copies is one row per task.
    """
    per_key = aggregate(df, keys, {"copies": "COUNT(*)"})
    rows = "coalesce(SUM(copies), 0)"
    return aggregate(
        per_key,
        [],
        {
            "table_name": text(table),
            "record_count": rows,
            "distinct_count": "COUNT(*)",
            "duplicate_count": f"{rows} - COUNT(*)",
        },
    )


def validation_report(df: DataFrame, table: str, expected: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row: counts, expected and actual columns, their differences, duplicates, time of the check."""
    actual = df.columns
    return duplicate_count(df, table, keys).selectExpr(
        "table_name",
        "record_count",
        f"{len(actual)} AS column_count",
        f"{array_of(expected)} AS expected_columns",
        f"{array_of(actual)} AS actual_columns",
        f"{array_of(c for c in expected if c not in set(actual))} AS missing_columns",
        f"{array_of(c for c in actual if c not in set(expected))} AS extra_columns",
        "duplicate_count",
        f"{NOW} AS validation_timestamp",
    )


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Reports of the same shape one below the other."""
    return reduce(DataFrame.unionByName, reports)


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and record_count of each frame."""
    counted = [aggregate(df, [], {"table_name": text(t), "record_count": "COUNT(*)"}) for t, df in frames.items()]
    return union_reports(counted)


def record_totals(counts: DataFrame) -> DataFrame:
    """Number of tables and rows over all steps."""
    return aggregate(counts, [], {"tables": "COUNT(*)", "total_records": "coalesce(SUM(record_count), 0)"})
