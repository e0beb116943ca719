"""Adapter: the retail test tables as the four raw shop tables.

The test tables are clean, so the adapter also puts in dirt by key arithmetic (missing ids, broken emails,
copies, wrong totals): every filter, rule and NULL path of the layers then has rows to act on.
The mapping is fixed by FIXTURES.md, part 3.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tradewind.config import Thresholds
from tradewind.functions.sql import array_of
from tradewind.sources.tables import read_layer

# The day after the last order, and segment edges that spread over the test data.
AS_OF = date(2001, 8, 2)
THRESHOLDS = Thresholds(
    order_value=(50_000.0, 150_000.0, 300_000.0),
    unit_price=(500.0, 2_000.0, 5_000.0),
    value=(1_000_000.0, 500_000.0, 100_000.0),
    sales=(300, 200, 100),
    demand=(15, 10, 5),
)
# Columns that settle which copy of a key survives cleaning.
SURVIVOR_ORDER = {
    "customers": ("ingest_seq",),
    "products": ("ingest_seq",),
    "orders": ("ingest_seq",),
    "order_items": ("product_id", "supplier_id"),
}


# The columns used of each test table. A declared schema spares every read the job that looks for one.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE",
}


_checked: set[tuple[str, str]] = set()


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A test table by its declared schema; once a session, its files are asked whether they have these columns.

    A column that the files lack would be read as NULL throughout.
    """
    path = f"{directory.rstrip('/')}/{name}.parquet"
    df = read_layer(spark, path, schema=SCHEMAS[name])
    seen = (spark.sparkContext.applicationId, path)
    if seen not in _checked:
        if missing := set(df.columns) - set(read_layer(spark, path).columns):
            raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
        _checked.add(seen)
    return df


def _half_up(amount: str, scaled: bool = False) -> str:
    """Two decimals by floor, which every SQL engine computes alike; ``scaled`` amounts are in hundredths."""
    hundredths = amount if scaled else f"{amount} * 100.0D"
    return f"floor({hundredths} + 0.5D) / 100.0D"


def _cycle(key: str, *values: str) -> str:
    return f"get({array_of(values)}, CAST({key} % {len(values)} AS INT))"


def _with_copies(df: DataFrame, key: str) -> DataFrame:
    """Every fiftieth row twice, told apart by ingest_seq."""
    return df.selectExpr("*", f"explode(IF({key} % 50 = 7, array(0, 1), array(0))) AS ingest_seq")


def raw_customers(spark: SparkSession, directory: str) -> DataFrame:
    nations = _table(spark, directory, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    joined = _table(spark, directory, "customer").join(nations, "c_nationkey")
    return _with_copies(joined, "c_custkey").selectExpr(
        "IF(c_custkey % 97 = 5, NULL, c_custkey) AS customer_id",
        f"{_cycle('c_custkey', ' ANNA', 'ben ', 'Chris')} AS first_name",
        f"{_cycle('c_custkey', 'van DYK', ' roe ', 'STONE', 'Hill')} AS last_name",
        "CASE WHEN c_custkey % 41 = 3 THEN NULL WHEN c_custkey % 53 = 9 THEN 'bad-email'"
        " ELSE concat(' User', c_custkey, '@Mail', c_custkey % 5, '.com') END AS email",
        "date_add(DATE '1993-01-01', CAST(c_custkey * 37 % 3130 AS INT)) AS registration_date",
        "concat(' ', n_name) AS country",
        "concat(' old TOWN ', c_custkey % 30) AS city",
        "CAST(15 + c_custkey % 90 AS INT) AS age",
        "c_mktsegment AS customer_segment",
        "ingest_seq",
    )


def raw_products(spark: SparkSession, directory: str) -> DataFrame:
    parts = _with_copies(_table(spark, directory, "part"), "p_partkey")
    list_price = _half_up("p_retailprice * CAST(1 + p_partkey % 20 AS DOUBLE) * 5.0D", scaled=True)
    box = "concat(5 + p_size % 46, 'x', 5 + p_partkey % 46, 'x', 2 + p_partkey % 29, ' cm')"
    return parts.selectExpr("*", f"IF(p_partkey % 61 = 8, 0.0D, {list_price}) AS price").selectExpr(
        "IF(p_partkey % 89 = 4, NULL, p_partkey) AS product_id",
        "concat(' ', upper(p_name)) AS product_name",
        "p_type AS category",
        "p_name AS sub_category",
        "p_brand AS brand",
        "price",
        f"{_half_up('price * CAST(4 + p_partkey % 8 AS DOUBLE) * 10.0D', scaled=True)} AS cost",
        "CAST(p_size AS DOUBLE) / 2.0D AS weight_kg",
        "CASE p_partkey % 71 WHEN 2 THEN '10x20' WHEN 3 THEN 'n/a' WHEN 4 THEN NULL" f" ELSE {box} END AS dimensions",
        "p_partkey % 5 <> 0 AS in_stock",
        "CAST(p_partkey % 37 AS INT) AS stock_quantity",
        "concat('supplier ', p_partkey % 12) AS supplier",
        "ingest_seq",
    )


def raw_orders(spark: SparkSession, directory: str) -> DataFrame:
    return _with_copies(_table(spark, directory, "orders"), "o_orderkey").selectExpr(
        "o_orderkey AS order_id",
        "IF(o_orderkey % 211 = 6, NULL, o_custkey) AS customer_id",
        "IF(o_orderkey % 223 = 8, NULL, CAST(o_orderdate AS DATE)) AS order_date",
        "CASE WHEN o_orderkey % 101 = 1 THEN 'returned' WHEN o_orderkey % 103 = 2 THEN 'Completed'"
        " WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'cancelled' END AS status",
        f"{_cycle('o_orderkey', ' CREDIT card', 'debit card', 'paypal', 'Bank Transfer ')} AS payment_method",
        f"{_cycle('o_orderkey', 'standard', 'EXPRESS', 'Overnight')} AS shipping_method",
        "IF(o_orderkey % 307 = 9, -o_totalprice, o_totalprice) AS order_total",
        f"{_half_up('o_totalprice * 8.0D', scaled=True)} AS tax_amount",
        "IF(o_orderstatus = 'F', CAST(5 + o_orderkey % 21 AS DOUBLE), 0.0D) AS shipping_cost",
        "ingest_seq",
    )


def raw_order_items(spark: SparkSession, directory: str) -> DataFrame:
    return _table(spark, directory, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS order_item_id",
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "IF(l_partkey % 401 = 7, 0, CAST(l_quantity AS INT)) AS quantity",
        f"{_half_up('l_extendedprice / l_quantity')} AS unit_price",
        "IF(l_partkey % 30 = 1, l_extendedprice + 5.0D, l_extendedprice) AS line_total",
        "CASE WHEN l_partkey % 45 = 2 THEN NULL WHEN l_partkey % 47 = 3 THEN -l_extendedprice"
        " WHEN l_partkey % 43 = 4 THEN floor(l_extendedprice * 20.0D) / 100.0D"
        f" ELSE {_half_up('l_extendedprice * l_discount')} END AS discount_amount",
        "l_suppkey AS supplier_id",
    )


RAW_TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customers": raw_customers,
    "products": raw_products,
    "orders": raw_orders,
    "order_items": raw_order_items,
}
