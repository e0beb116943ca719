"""The data behind the charts: each a small aggregate of a gold table.

Where a result keeps one row per customer or product it is a projection, to be written or sampled
by the caller, never pulled to the driver here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.money import money_avg, money_sum, percent, ratio
from tradewind.functions.sql import aggregate, long_form, text
from tradewind.operators.reuse import computed_once
from tradewind.plans.kpis import BEST_CATEGORY, COUNT_ACTIVE, COUNT_HIGH_VALUE, COUNT_SOLD


def value_counts(df: DataFrame, column: str, name: str = "customer_count") -> DataFrame:
    """Rows per value, most frequent first, equal counts by value; NULL is no value."""
    counted = aggregate(df.filter(f"{column} IS NOT NULL"), [column], {name: "COUNT(*)"})
    return counted.orderBy(F.desc(name), column)


def top_countries(customers: DataFrame, n: int = 10) -> DataFrame:
    return value_counts(customers, "country").limit(n)


def country_summary(customers: DataFrame, n: int = 15) -> DataFrame:
    """The first countries by name with customers, money spent and mean order value.

    The order value is no whole number of cents; its mean comes from exact sums of eight decimals.
    """
    mean = "CAST(SUM(CAST(avg_order_value AS DECIMAL(28,8))) AS DOUBLE) / NULLIF(COUNT(avg_order_value), 0)"
    countries = aggregate(
        customers,
        ["country"],
        {"customer_count": "COUNT(customer_id)", "total_revenue": money_sum("total_spent"), "avg_order_value": mean},
    )
    return countries.orderBy("country").limit(n)


def spending_points(customers: DataFrame) -> DataFrame:
    columns = ("total_spent", "total_orders", "value_segment", "days_since_last_order")
    return customers.select("customer_id", "full_name", "country", "recency_segment", *columns)


def revenue_by_category(products: DataFrame) -> DataFrame:
    totals = aggregate(products, ["category"], {"total_revenue": money_sum("total_revenue")})
    return totals.orderBy("total_revenue", "category")


def product_points(products: DataFrame) -> DataFrame:
    columns = ("price", "total_revenue", "total_quantity_sold", "profit_margin_pct", "sales_performance")
    return products.select("product_id", "product_name", "category", *columns)


def best_sellers(products: DataFrame, n: int = 10) -> DataFrame:
    ordered = products.orderBy(F.desc("total_quantity_sold"), "product_id").limit(n)
    return ordered.select("product_id", "product_name", "total_quantity_sold")


def category_stats(products: DataFrame) -> DataFrame:
    stats = aggregate(
        products,
        ["category"],
        {
            "total_revenue": money_sum("total_revenue"),
            "total_quantity": "SUM(total_quantity_sold)",
            "product_count": "COUNT(product_id)",
            "avg_profit_margin": money_avg("profit_margin_pct"),
        },
    )
    return stats.orderBy("category")


def monthly_trend(months: DataFrame) -> DataFrame:
    columns = ("year_month", "total_revenue", "total_orders", "avg_order_value", "unique_customers")
    return months.orderBy("order_year", "order_month").select(*columns)


def daily_revenue(days: DataFrame) -> DataFrame:
    return days.selectExpr("to_date(order_date) AS order_date", "total_revenue").orderBy("order_date")


def weekday_performance(days: DataFrame) -> DataFrame:
    """Mean revenue, orders and customers of a day, weekdays against weekends."""
    means = aggregate(
        days,
        ["weekday_performance"],
        {
            "avg_revenue": money_avg("total_revenue"),
            "avg_orders": "SUM(total_orders) / COUNT(*)",
            "avg_customers": "SUM(unique_customers) / COUNT(*)",
        },
    )
    return means.orderBy("weekday_performance")


def retention_matrix(cohorts: DataFrame) -> DataFrame:
    """cohort_month, and ``rates``: a map from full months since the first purchase to the retention.

    A row is as wide as its cohort is old, so no column list has to be known, and no job runs to find one.
    """
    pair = F.struct(F.col("months_since_first_purchase"), F.col("retention_rate"))
    entries = F.array_sort(F.collect_list(F.when(F.col("months_since_first_purchase").isNotNull(), pair)))
    # Bounded: a cohort has one row per month of age.
    return cohorts.groupBy("cohort_month").agg(F.map_from_entries(entries).alias("rates")).orderBy("cohort_month")


def retention_table(cohorts: DataFrame, months: Sequence[int]) -> DataFrame:
    """The matrix with a column ``month_<n>`` for each of ``months``, for a chart of known width.

    A cohort with a rate for an age that isn't among them stops the query, as its rates would be lost.
    """
    named = f"array({', '.join(str(int(m)) for m in months)})" if months else "CAST(array() AS ARRAY<INT>)"
    other = f"array_except(map_keys(rates), {named})"
    checked = (
        f"IF(size({other}) > 0, raise_error(concat('cohort ', cohort_month, ' has rates for months that are not among the columns: ',"
        f" array_join({other}, ', '))), cohort_month) AS cohort_month"
    )
    return retention_matrix(cohorts).selectExpr(checked, *[f"rates[{int(m)}] AS month_{int(m)}" for m in months])


def retention_rates(cohorts: DataFrame) -> DataFrame:
    """The matrix in long form, one row per cohort and age: as many rows as there are, whatever their ages."""
    return cohorts.select("cohort_month", "months_since_first_purchase", "retention_rate")


def cohort_sizes_at_start(cohorts: DataFrame) -> DataFrame:
    started = cohorts.filter("months_since_first_purchase = 0")
    return started.select("cohort_month", "cohort_size").orderBy("cohort_month")


def executive_metrics(customers: DataFrame, products: DataFrame, months: DataFrame) -> DataFrame:
    """metric, value: counts, shares and money of the business; empty tables give 0."""
    revenue = money_sum("total_revenue")

    def long(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
        totals = aggregate(df, [], metrics)
        return long_form(totals, [{"metric": text(m), "value": f"CAST({m} AS DOUBLE)"} for m in metrics])

    of_customers = long(
        customers,
        {
            "total_customers": "COUNT(*)",
            "active_customers": COUNT_ACTIVE,
            "active_pct": percent(COUNT_ACTIVE, "COUNT(*)", 1),
            "high_value_customers": COUNT_HIGH_VALUE,
            "high_value_pct": percent(COUNT_HIGH_VALUE, "COUNT(*)", 1),
        },
    )
    of_products = long(
        products,
        {
            "total_products": "COUNT(*)",
            "products_with_sales": COUNT_SOLD,
            "products_with_sales_pct": percent(COUNT_SOLD, "COUNT(*)", 1),
        },
    )
    of_months = long(
        months,
        {
            "total_revenue": f"coalesce({revenue}, 0.0D)",
            "total_orders": "coalesce(SUM(total_orders), 0)",
            "avg_order_value": f"round({ratio(revenue, 'SUM(total_orders)')}, 2)",
        },
    )
    return of_customers.unionByName(of_products).unionByName(of_months)


def top_category(categories: DataFrame) -> DataFrame:
    best = aggregate(categories, [], {"category": BEST_CATEGORY, "total_revenue": "MAX(total_revenue)"})
    return best.filter("total_revenue IS NOT NULL")


def order_value_histogram(customers: DataFrame, bins: int = 20, column: str = "avg_order_value") -> DataFrame:
    """Customers per equal-width bin between the smallest and the largest value; empty bins are left out.

    The customers are counted per value first, in one pass; borders and bins come from these counts.
    """
    counts = aggregate(customers.filter(f"{column} IS NOT NULL"), [column], {"n": "COUNT(*)"}).withColumnRenamed(column, "v")
    return computed_once(counts, lambda kept: _binned(kept, bins))


def _binned(counts: DataFrame, bins: int) -> DataFrame:
    """The histogram of (value v, number n)."""
    borders = counts.selectExpr("struct(MIN(v) AS low, MAX(v) AS high) AS borders").scalar()
    place = f"floor({bins} * (v - b.low) / NULLIF(b.high - b.low, 0.0D)) + 1"
    binned = counts.select("v", "n", borders.alias("b")).selectExpr(
        f"CAST(least(coalesce({place}, 1), {bins}) AS INT) AS bin", "b.low", "b.high", "n"
    )
    counted = aggregate(binned, ["bin", "low", "high"], {"customer_count": "SUM(n)"})
    return counted.selectExpr(
        "bin",
        f"low + (bin - 1) * (high - low) / {bins} AS bin_start",
        f"low + bin * (high - low) / {bins} AS bin_end",
        "customer_count",
    ).orderBy("bin")


def top_age_group(customers: DataFrame) -> DataFrame:
    spending = aggregate(customers, ["customer_age_group"], {"avg_spent": money_avg("total_spent")})
    return spending.orderBy(F.desc("avg_spent"), "customer_age_group").limit(1)


def churn_rate(customers: DataFrame) -> DataFrame:
    churned = "count_if(recency_segment = 'Churned')"
    return aggregate(
        customers,
        [],
        {
            "churned_customers": churned,
            "total_customers": "COUNT(*)",
            "churn_rate": f"{ratio(churned, 'COUNT(*)')} * 100",
        },
    )


def revenue_by_country(customers: DataFrame) -> DataFrame:
    totals = aggregate(customers, ["country"], {"total_revenue": money_sum("total_spent")})
    return totals.orderBy(F.desc("total_revenue"), "country")


def top_revenue_country(customers: DataFrame) -> DataFrame:
    return revenue_by_country(customers).limit(1)


def raw_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """metric, number, day: money and completion of raw orders, and the date ranges that arrived."""
    done, finished = "IF(status = 'completed', order_total, NULL)", "count_if(status = 'completed')"
    of_orders = aggregate(
        orders,
        [],
        {
            "total_revenue": money_sum(done),
            "avg_order_value": money_avg(done),
            "completion_rate": f"{ratio(finished, 'COUNT(*)')} * 100",
            "first_order": "MIN(order_date)",
            "last_order": "MAX(order_date)",
        },
    )
    of_customers = aggregate(
        customers,
        [],
        {"first_registration": "MIN(registration_date)", "last_registration": "MAX(registration_date)"},
    )

    def row(metric: str, number: str = "NULL", day: str = "NULL") -> dict[str, str]:
        return {"metric": text(metric), "number": f"CAST({number} AS DOUBLE)", "day": f"CAST({day} AS DATE)"}

    numbers = [row(m, number=m) for m in ("total_revenue", "avg_order_value", "completion_rate")]
    days = [row(m, day=m) for m in ("first_order", "last_order")]
    registrations = [row(m, day=m) for m in ("first_registration", "last_registration")]
    return long_form(of_orders, numbers + days).unionByName(long_form(of_customers, registrations))
