"""Business KPIs as a long table, and the small top-n reports over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.money import money_sum, percent, ratio
from tradewind.functions.sql import aggregate, long_form, text
from tradewind.functions.text import plain_number
from tradewind.plans.bronze import union_reports

# Segments that count as active and as high value, and the name for "none".
ACTIVE_SEGMENTS = ("Recent", "Active")
HIGH_VALUE = "High Value"
NO_CATEGORY = "N/A"

COUNT_ACTIVE = f"count_if(recency_segment IN {ACTIVE_SEGMENTS})"
COUNT_HIGH_VALUE = f"count_if(value_segment = {text(HIGH_VALUE)})"
COUNT_SOLD = "count_if(total_quantity_sold > 0)"
# Equal revenue goes to the first name.
BEST_CATEGORY = "min_by(category, struct(-total_revenue, category))"


def _metric(name: str, number: str, kind: str, group: str, shown: str | None = None) -> dict[str, str]:
    if shown is None:
        shown = f"CAST(CAST({number} AS BIGINT) AS STRING)" if kind == "count" else plain_number(number)
    return {
        "metric_name": text(name),
        "metric_value": shown,
        "metric_type": text(kind),
        "category": text(group),
        "metric_number": f"CAST({number} AS DOUBLE)",
    }


def business_kpis(
    customers: DataFrame, products: DataFrame, months: DataFrame, categories: DataFrame
) -> DataFrame:
    """Eleven KPIs: metric_name, metric_value (text), metric_type, category, metric_number.

    One aggregation per gold table, each turned to long form on its own, so nothing is crossed.
    """
    of_customers = aggregate(
        customers, [], {"total": "COUNT(*)", "active": COUNT_ACTIVE, "high_value": COUNT_HIGH_VALUE}
    )
    of_products = aggregate(products, [], {"total": "COUNT(*)", "sold": COUNT_SOLD})
    of_categories = aggregate(categories, [], {"best": f"coalesce({BEST_CATEGORY}, {text(NO_CATEGORY)})"})
    return _kpi_rows(of_customers, of_products, _months_total(months), of_categories)


def business_kpis_from_standing(customers: DataFrame, by_category: DataFrame, months: DataFrame) -> DataFrame:
    """The same KPIs from ``gold.customer_standing``, ``gold.product_standing`` and the months, with no gold table in between."""
    of_customers = aggregate(
        customers, [], {"total": "COUNT(*)", "active": COUNT_ACTIVE, "high_value": COUNT_HIGH_VALUE}
    )
    best = f"{BEST_CATEGORY} FILTER (WHERE lines_found > 0)"
    of_products = aggregate(
        by_category,
        [],
        {
            "total": "coalesce(SUM(products), 0)",
            "sold": "coalesce(SUM(products_sold), 0)",
            "best": f"coalesce({best}, {text(NO_CATEGORY)})",
        },
    )
    return _kpi_rows(of_customers, of_products, _months_total(months), None)


def _months_total(months: DataFrame) -> DataFrame:
    return aggregate(
        months,
        [],
        {
            "revenue": f"coalesce({money_sum('total_revenue')}, 0.0D)",
            "orders": "coalesce(SUM(total_orders), 0)",
        },
    )


def _kpi_rows(
    of_customers: DataFrame, of_products: DataFrame, of_months: DataFrame, of_categories: DataFrame | None
) -> DataFrame:
    """The totals in long form; without ``of_categories`` the best category is a column of ``of_products``.

    Fixed values: names, kinds and groups of the metrics.
    """
    average = f"round({ratio('revenue', 'orders')}, 2)"
    customers = [
        _metric("Total Customers", "total", "count", "Customer"),
        _metric("Active Customers", "active", "count", "Customer"),
        _metric("Customer Activation Rate", percent("active", "total"), "percentage", "Customer"),
        _metric("High Value Customers", "high_value", "count", "Customer"),
    ]
    months = [
        _metric("Total Revenue", "round(revenue, 2)", "currency", "Revenue"),
        _metric("Total Orders", "orders", "count", "Orders"),
        _metric("Average Order Value", average, "currency", "Orders"),
    ]
    products = [
        _metric("Total Products", "total", "count", "Product"),
        _metric("Products with Sales", "sold", "count", "Product"),
        _metric("Product Sales Rate", percent("sold", "total"), "percentage", "Product"),
    ]
    best = [_metric("Top Category", "NULL", "text", "Product", "best")]
    reports = [long_form(of_customers, customers), long_form(of_months, months)]
    if of_categories is None:
        return union_reports([*reports, long_form(of_products, products + best)])
    return union_reports([*reports, long_form(of_products, products), long_form(of_categories, best)])


def stamped_kpis(kpis: DataFrame, created_at: str = "current_timestamp()") -> DataFrame:
    """The stored form: metric values as text with date and time of the calculation."""
    return kpis.selectExpr(
        "* EXCEPT (metric_number)",
        f"CAST({created_at} AS DATE) AS kpi_date",
        f"CAST({created_at} AS TIMESTAMP) AS kpi_timestamp",
    )


def top_customers(customers: DataFrame, n: int = 5) -> DataFrame:
    columns = ("customer_id", "full_name", "total_spent", "total_orders", "value_segment")
    return customers.select(*columns).orderBy(F.desc("total_spent"), "customer_id").limit(n)


def top_products(products: DataFrame, n: int = 5) -> DataFrame:
    columns = ("product_id", "product_name", "category", "total_revenue", "total_quantity_sold")
    return products.select(*columns).orderBy(F.desc("total_revenue"), "product_id").limit(n)


def first_months(months: DataFrame, n: int = 10) -> DataFrame:
    ordered = months.orderBy("order_year", "order_month").limit(n)
    return ordered.select("year_month", "total_orders", "total_revenue", "avg_order_value")


def category_overview(categories: DataFrame) -> DataFrame:
    return categories.select("category", "total_revenue", "unique_customers", "avg_selling_price")


# The two reports that are kept as SQL text, to run over registered tables or views.
AGE_GROUP_SQL = """
SELECT customer_age_group, count(*) AS customer_count
FROM {customers}
GROUP BY customer_age_group
ORDER BY customer_count DESC, customer_age_group
"""
LATEST_MONTHS_SQL = """
SELECT order_year, order_month, total_orders
FROM {months}
ORDER BY order_year DESC, order_month DESC
LIMIT 12
"""


def customers_per_age_group(customers: DataFrame) -> DataFrame:
    return customers.sparkSession.sql(AGE_GROUP_SQL, customers=customers)


def latest_months(months: DataFrame) -> DataFrame:
    return months.sparkSession.sql(LATEST_MONTHS_SQL, months=months)
