"""Data quality: rule sets, references between tables, reconciliation, NULLs in gold, lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tradewind.config import TABLES
from tradewind.functions.money import money_sum, off_scale
from tradewind.functions.sql import aggregate, array_of, long_form, text
from tradewind.operators.rules import AnyRule, Rule, UniqueRule, check_rules, counts_and_scores
from tradewind.plans.bronze import row_counts, union_reports

# The rules of each silver table.
SILVER_RULES: dict[str, tuple[AnyRule, ...]] = {
    "customers": (
        Rule("no_null_customer_id", "customer_id IS NOT NULL"),
        Rule("valid_email_format", r"email RLIKE '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$'"),
        Rule("valid_age_range", "age BETWEEN 18 AND 100"),
        UniqueRule("no_duplicate_customers", "customer_id"),
    ),
    "products": (
        Rule("no_null_product_id", "product_id IS NOT NULL"),
        Rule("positive_price", "price > 0"),
        Rule("positive_cost", "cost > 0"),
        Rule("valid_profit_margin", "profit_margin_pct >= 0"),
        Rule("price_greater_than_cost", "price >= cost"),
    ),
    "orders": (
        Rule("no_null_order_id", "order_id IS NOT NULL"),
        Rule("no_null_customer_id", "customer_id IS NOT NULL"),
        Rule("valid_status", "status IN ('completed', 'pending', 'cancelled')"),
        Rule("non_negative_total", "order_total >= 0"),
        Rule("valid_order_date", "order_date IS NOT NULL"),
    ),
    "order_items": (
        Rule("no_null_item_id", "order_item_id IS NOT NULL"),
        Rule("positive_quantity", "quantity > 0"),
        Rule("positive_unit_price", "unit_price > 0"),
        Rule("non_negative_total", "line_total_corrected >= 0"),
        Rule("valid_discount", "discount_amount >= 0"),
    ),
}
# What must hold for silver customers before anything is built on them.
REQUIRED_CUSTOMER_RULES: tuple[AnyRule, ...] = (
    Rule("email_present", "email IS NOT NULL"),
    Rule("age_in_range", "NOT (age < 18 OR age > 100)"),
    UniqueRule("customer_id_unique", "customer_id"),
)
# Key figures of each gold table, the score steps, and the tolerance in money.
GOLD_KEY_COLUMNS = {
    "customer_analytics": ("customer_id", "total_spent", "total_orders"),
    "product_analytics": ("product_id", "total_revenue", "sales_performance"),
    "monthly_sales": ("order_year", "order_month", "total_revenue"),
    "daily_sales": ("order_date", "total_revenue"),
    "category_sales": ("category", "total_revenue"),
    "cohort_analysis": ("cohort_month", "retention_rate"),
}
PASS_SCORE, WARNING_SCORE = 90, 70
TOTAL_TOLERANCE = 0.01
LINEAGE_RULES = ("null_removal", "duplicate_removal", "data_validation", "standardization", "enrichment")


def silver_rule_results(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Verdicts of all silver rules; one scan per table."""
    return union_reports([check_rules(df, table, SILVER_RULES[table]) for table, df in silver.items()])


def _one_check(name: str, totals: DataFrame, count: str) -> DataFrame:
    failed = f"CAST(coalesce({count}, 0) AS BIGINT)"
    return aggregate(totals, [], {"check_name": text(name), "failed_count": failed, "passed": f"{failed} = 0"})


def orphans(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of child rows whose key has no parent; a NULL key has none.

    Child rows are counted per key first: what is shuffled and matched is one row per key, however
    many rows a single key holds.
    """
    per_key = aggregate(child, [key], {"held": "COUNT(*)"})
    return _one_check(name, per_key.join(parent.select(key), key, "left_anti"), "SUM(held)")


def orders_without_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orphans("orders_with_invalid_customers", orders, customers, "customer_id")


def items_without_order(items: DataFrame, orders: DataFrame) -> DataFrame:
    return orphans("items_with_invalid_orders", items, orders, "order_id")


def items_without_product(items: DataFrame, products: DataFrame) -> DataFrame:
    return orphans("items_with_invalid_products", items, products, "product_id")


def order_total_mismatches(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of their lines; orders without lines are not judged."""
    lines = aggregate(items, ["order_id"], {"line_sum": money_sum("line_total_corrected")})
    compared = orders.select("order_id", "order_total").join(lines, "order_id")
    return _one_check(
        "order_total_mismatches", compared, f"count_if(abs(order_total - line_sum) > {TOTAL_TOLERANCE}D)"
    )


def _item_checks_by_order(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items without order and order totals that do not add up, from one pass over the items.

    One row per order id is matched with the orders; a missing match is an orphan, a match is compared.
    """
    lines = aggregate(items, ["order_id"], {"held": "COUNT(*)", "line_sum": money_sum("line_total_corrected")})
    known = orders.selectExpr("order_id", "order_total", "true AS found")
    totals = aggregate(
        lines.join(known, "order_id", "left"),
        [],
        {
            "lost": "CAST(coalesce(SUM(IF(found IS NULL, held, 0)), 0) AS BIGINT)",
            "off": f"count_if(abs(order_total - line_sum) > {TOTAL_TOLERANCE}D)",
        },
    )
    names = (("items_with_invalid_orders", "lost"), ("order_total_mismatches", "off"))
    return long_form(
        totals, [{"check_name": text(n), "failed_count": c, "passed": f"{c} = 0"} for n, c in names]
    )


def cross_table_checks(silver: Mapping[str, DataFrame]) -> DataFrame:
    """check_name, failed_count, passed for the three references and the reconciliation.

    The two checks of items against orders share their scan, aggregation and join.
    """
    orders, items = silver["orders"], silver["order_items"]
    return union_reports(
        [
            orders_without_customer(orders, silver["customers"]),
            items_without_product(items, silver["products"]),
            _item_checks_by_order(orders, items),
        ]
    )


# Columns that are added up as money.
MONEY_COLUMNS = {
    "orders": ("order_total", "tax_amount", "shipping_cost"),
    "order_items": ("line_total_corrected", "discount_amount", "unit_price"),
}


def money_scale_checks(silver: Mapping[str, DataFrame]) -> DataFrame:
    """check_name, failed_count, passed: amounts with more decimals than sums of money keep; one scan per table."""
    reports = []
    for table, columns in MONEY_COLUMNS.items():
        totals = aggregate(silver[table], [], {c: f"count_if({off_scale(c)})" for c in columns})
        rows = [
            {"check_name": text(f"{table}_{c}_off_scale"), "failed_count": c, "passed": f"{c} = 0"} for c in columns
        ]
        reports.append(long_form(totals, rows))
    return union_reports(reports)


def money_metrics(table: str) -> dict[str, str]:
    """name -> aggregate of the amounts off scale, to be counted by the write of a table."""
    return {f"money_{c}": f"count_if({off_scale(c)})" for c in MONEY_COLUMNS.get(table, ())}


def money_scale_of_counts(spark: SparkSession, counts: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The checks of ``money_scale_checks`` from what the writes of the tables counted."""
    rows = [
        (f"{table}_{c}_off_scale", int(counts[table][f"money_{c}"] or 0), not counts[table][f"money_{c}"])
        for table, columns in MONEY_COLUMNS.items() if table in counts for c in columns
    ]
    return spark.createDataFrame(rows, "check_name string, failed_count bigint, passed boolean")


def checks_passed(checks: DataFrame) -> DataFrame:
    return aggregate(checks, [], {"checks_passed": "count_if(passed)", "checks_total": "COUNT(*)"})


def null_issues(columns: Sequence[str], table: str) -> str:
    """Aggregate: NULLs among the key figures of a gold table."""
    return " + ".join(f"count_if({c} IS NULL)" for c in GOLD_KEY_COLUMNS[table] if c in columns) or "CAST(0 AS BIGINT)"


def null_assessment(df: DataFrame, table: str) -> DataFrame:
    """table_name, total_records, null_issues, quality_score, status from the key figures; one scan."""
    totals = aggregate(df, [], {"total_records": "COUNT(*)", "null_issues": null_issues(df.columns, table)})
    return _graded(totals.selectExpr(f"{text(table)} AS table_name", "*"))


def assessment_of_counts(spark: SparkSession, counts: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The same from (records, NULLs) of each table as its write counted them."""
    rows = [(table, records, nulls) for table, (records, nulls) in counts.items()]
    return _graded(spark.createDataFrame(rows, "table_name string, total_records bigint, null_issues bigint"))


def _graded(totals: DataFrame) -> DataFrame:
    # Graded on the full score; only the reported score is rounded.
    score = "IF(total_records > 0, greatest(0.0D, 100.0D - null_issues / total_records * 100), 0.0D)"
    return totals.selectExpr(
        "table_name",
        "total_records",
        "null_issues",
        f"round({score}, 1) AS quality_score",
        f"CASE WHEN {score} >= {PASS_SCORE} THEN 'PASS' WHEN {score} >= {WARNING_SCORE} THEN 'WARNING' ELSE 'FAIL' END"
        " AS status",
    )


def gold_assessment(gold: Mapping[str, DataFrame]) -> DataFrame:
    return union_reports([null_assessment(df, table) for table, df in gold.items()])


def _repeated_values(name: str, df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each value."""
    return _one_check(name, aggregate(df, [key], {"n": "COUNT(*)"}), "SUM(n - 1)")


def raw_checks(raw: Mapping[str, DataFrame]) -> DataFrame:
    """check_name, failed_count, passed for the tables as they arrived.

    Repeated ids and the cell checks of a table share one aggregation by its key; only the e-mail addresses need another.
    """
    customers, products = raw["customers"], raw["products"]
    empty_cells = " + ".join(f"CAST(`{c}` IS NULL AS INT)" for c in customers.columns)

    def by_key(df: DataFrame, key: str, repeats: str, cells: Mapping[str, str]) -> DataFrame:
        per_key = aggregate(df, [key], {"n": "COUNT(*)", **{name: f"SUM({sql})" for name, sql in cells.items()}})
        totals = aggregate(per_key, [], {repeats: "SUM(n - 1)", **{name: f"SUM({name})" for name in cells}})
        failed = {name: f"CAST(coalesce({name}, 0) AS BIGINT)" for name in (repeats, *cells)}
        return long_form(
            totals, [{"check_name": text(n), "failed_count": c, "passed": f"{c} = 0"} for n, c in failed.items()]
        )

    return union_reports(
        [
            by_key(customers, "customer_id", "duplicate_customer_ids", {"null_customer_values": empty_cells}),
            _repeated_values("duplicate_customer_emails", customers, "email"),
            by_key(products, "product_id", "duplicate_product_ids", {"price_not_above_cost": "CAST(price <= cost AS INT)"}),
            _repeated_values("duplicate_order_ids", raw["orders"], "order_id"),
            _repeated_values("duplicate_order_item_ids", raw["order_items"], "order_item_id"),
        ]
    )


def lineage_from_counts(bronze: DataFrame, silver: DataFrame, scores: DataFrame) -> DataFrame:
    """Lineage rows from (table_name, record_count) of both layers and (table_name, quality_score).

    All three inputs have one row per table; a table without bronze rows counts as 0.
    """
    return _lineage_rows(bronze, silver.join(scores.select("table_name", "quality_score"), "table_name", "left"))


def _lineage_rows(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    after = silver.selectExpr("table_name", "record_count AS silver_records", "quality_score AS score")
    joined = after.join(bronze.selectExpr("table_name", "record_count AS before"), "table_name", "left")
    return joined.selectExpr(
        "table_name",
        "coalesce(before, 0) AS bronze_records",
        "silver_records",
        "silver_records - bronze_records AS record_change",
        "IF(bronze_records > 0, round(record_change / bronze_records * 100, 2), 0.0D) AS change_percentage",
        f"{array_of(LINEAGE_RULES)} AS transformation_rules",
        "coalesce(score, 0.0D) AS quality_score",
        "current_timestamp() AS lineage_timestamp",
    )


def lineage(bronze: Mapping[str, DataFrame], silver: Mapping[str, DataFrame]) -> DataFrame:
    """Lineage rows straight from the frames, for use outside a run; each table is read once per layer."""
    tables = [t for t in TABLES if t in silver]
    scored = union_reports([counts_and_scores(silver[t], t, SILVER_RULES[t]) for t in tables])
    return _lineage_rows(row_counts({t: bronze[t] for t in tables if t in bronze}), scored)
