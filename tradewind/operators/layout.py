"""Clustered file layout: neighbouring keys in the same files, so min/max statistics prune."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

# The columns each table is most often filtered by.
CLUSTER_COLUMNS = {
    "silver_customers": ("customer_id", "country"),
    "silver_products": ("product_id", "category"),
    "silver_orders": ("order_id", "customer_id", "order_date"),
    "silver_order_items": ("order_id", "product_id"),
    "gold_customer_analytics": ("customer_id", "value_segment", "country"),
    "gold_product_analytics": ("product_id", "category", "sales_performance"),
    "gold_monthly_sales": ("order_year", "order_month"),
    "gold_daily_sales": ("order_date",),
    "gold_category_sales": ("category",),
    "gold_cohort_analysis": ("cohort_month",),
    "gold_cohort_by_month": ("cohort_month",),
}
# Columns that make the range key unique, so that one hot value can spread over many ranges.
SPLIT_COLUMNS = {"silver_order_items": ("order_item_id",)}


BITS = 6  # ranges per column: 64
_KEY = "__cluster_key"
_BORDERS = "__cluster_borders"


def _number(df: DataFrame, column: str) -> str:
    """A number in the order of the column: itself, its days or seconds, or the first seven bytes of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return f"`{column}`"
    if isinstance(kind, DateType):
        return f"unix_date(`{column}`)"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return f"unix_seconds(CAST(`{column}` AS TIMESTAMP))"
    return f"CAST(conv(hex(substr(CAST(`{column}` AS STRING), 1, 7)), 16, 10) AS BIGINT)"


def interleaved(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with a key in which the columns take turns bit by bit, from the coarsest range of each to the finest.

    The ranges of a column lie between quantiles of it, which one aggregation finds for all columns; as a scalar
    subquery it starts no job while the plan is built. NULLs are in the first range.
    """
    levels = 1 << BITS
    shares = ", ".join(f"{i / levels}D" for i in range(1, levels))
    found = [f"array_distinct(percentile_approx({_number(df, c)}, array({shares}))) AS b{i}" for i, c in enumerate(columns)]
    borders = df.selectExpr(*found).selectExpr(f"struct({', '.join(f'b{i}' for i in range(len(columns)))}) AS b").scalar()
    marked = df.withColumn(_BORDERS, borders)

    def place(i: int, column: str) -> str:
        of, number = f"coalesce({_BORDERS}.b{i}, array())", _number(df, column)
        return f"CAST(coalesce(size(filter({of}, b -> b < {number})), 0) * {levels} DIV (size({of}) + 1) AS BIGINT)"

    woven = []
    for bit in range(BITS):
        for i, column in enumerate(columns):
            at = bit * len(columns) + (len(columns) - 1 - i)
            woven.append(f"shiftleft(shiftright({place(i, column)}, {bit}) & 1L, {at})")
    return marked.withColumn(_KEY, F.expr(" | ".join(woven))).drop(_BORDERS)


def cluster(df: DataFrame, columns: Sequence[str], split_by: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Range-partition and sort by the interleaved ``columns``, then by the columns themselves and ``split_by``.

    Neighbours in any of the columns are then in few files, not only neighbours in the first. Without ``files``
    the run-time planner sizes the partitions, and with them the files.
    """
    keys = [_KEY, *columns, *[c for c in split_by if c not in columns]]
    marked = interleaved(df, columns)
    ranged = marked.repartitionByRange(*keys) if files is None else marked.repartitionByRange(files, *keys)
    return ranged.sortWithinPartitions(*keys).drop(_KEY)


def cluster_table(df: DataFrame, table: str, files: int | None = None) -> DataFrame:
    return cluster(df, CLUSTER_COLUMNS[table], SPLIT_COLUMNS.get(table, ()), files)
