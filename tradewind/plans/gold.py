"""Gold: customer, product, sales and cohort tables from the cleaned tables.

Completed orders only, unless a function says otherwise. Sums of money are exact (whole millionths) until
the last step, so a result does not depend on the partitioning.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.config import Thresholds
from tradewind.functions import calendar, segments
from tradewind.functions.money import micros_sum, percent, ratio, total_of_micros
from tradewind.functions.sql import add, aggregate, text
from tradewind.operators.ranking import global_rank, small_rank
from tradewind.operators.reuse import computed_once

# Status counted as a sale, version stamp, and the labels of the segments.
COMPLETED = "completed"
ANALYTICS_VERSION = "1.0"
VALUE_LABELS = ("High Value", "Medium Value", "Low Value")
RECENCY_LABELS = ("Recent", "Active", "At Risk")
FREQUENCY_LABELS = ("Frequent", "Regular", "Occasional")
SALES_LABELS = ("Top Seller", "Good Seller", "Average Seller")
DEMAND_LABELS = ("High Demand", "Medium Demand", "Low Demand")
CUSTOMER_COLUMNS = (
    "customer_id", "full_name", "email", "country", "city", "customer_age_group", "customer_segment",
    "registration_date", "days_since_registration", "customer_lifetime_category",
)
PRODUCT_COLUMNS = (
    "product_id", "product_name", "category", "sub_category", "brand", "price", "cost", "profit_margin_pct",
    "profit_amount", "price_category", "weight_category", "availability_status", "stock_quantity", "in_stock",
)


NOW = "current_timestamp()"


def with_metadata(df: DataFrame, created_at: str = NOW, updated: bool = True) -> DataFrame:
    stamps = {
        "gold_created_timestamp": f"CAST({created_at} AS TIMESTAMP)",
        "gold_created_date": f"CAST({created_at} AS DATE)",
        "analytics_version": text(ANALYTICS_VERSION),
    }
    if updated:
        stamps["last_updated"] = f"CAST({created_at} AS TIMESTAMP)"
    return add(df, stamps)


def _filled(defaults: dict[str, str]) -> list[str]:
    return [f"coalesce({name}, {value}) AS {name}" for name, value in defaults.items()]


def completed(orders: DataFrame) -> DataFrame:
    return orders.filter(f"status = {text(COMPLETED)}")


def sales_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sold lines at the grain (order, product), with customer and date of the order.

    All item reports start here. Lines are added up before the join: a hot (order, product) pair
    shrinks in the map tasks, and because no later step groups by order alone, the planner stays
    free to split the join partition of an order that holds a large share of the lines.
    """
    lines = aggregate(
        items,
        ["order_id", "product_id"],
        {
            "quantity": "SUM(quantity)",
            "revenue_micros": micros_sum("line_total_corrected"),
            "discount_micros": micros_sum("discount_amount"),
            "price_micros": micros_sum("unit_price"),
            "priced_lines": "COUNT(unit_price)",
            "lines": "COUNT(*)",
        },
    )
    return lines.join(completed(orders).select("order_id", "customer_id", "order_date"), "order_id")


# What a finer group keeps of its orders, so that a coarser group can count it once and add up the rest.
ORDER_PARTS = {
    "orders": "COUNT(order_id)",
    "priced_orders": "COUNT(order_total)",
    "revenue_micros": micros_sum("order_total"),
}
REVENUE = total_of_micros("revenue_micros")
AVERAGE_ORDER = f"{REVENUE} / NULLIF(SUM(priced_orders), 0)"
LINE_PARTS = ("quantity", "revenue_micros", "discount_micros", "price_micros", "priced_lines", "lines")


def _line_sums(discounts: str, line_count: str) -> dict[str, str]:
    """Totals of sales lines under the names the reports use."""
    return {
        "total_quantity_sold": "SUM(quantity)",
        "total_revenue": REVENUE,
        discounts: total_of_micros("discount_micros"),
        line_count: "SUM(lines)",
        "avg_selling_price": f"{total_of_micros('price_micros')} / NULLIF(SUM(priced_lines), 0)",
    }


# Customers -------------------------------------------------------------------------------------


def customer_order_metrics(orders: DataFrame) -> DataFrame:
    """Per customer: counts, sums and dates of completed orders.

    Added up per (customer, year) first: years are then rows to count, and a customer with very many orders
    leaves each task as one row per year. Months are counted with a bit mask.
    """
    per_year = aggregate(
        completed(orders),
        ["customer_id", "order_year"],
        {
            **ORDER_PARTS,
            "tax_micros": micros_sum("tax_amount"),
            "shipping_micros": micros_sum("shipping_cost"),
            "last": "MAX(order_date)",
            "first": "MIN(order_date)",
            "months": calendar.month_mask("order_month"),
        },
    )
    return aggregate(
        per_year,
        ["customer_id"],
        {
            "total_orders": "SUM(orders)",
            "total_spent": REVENUE,
            "avg_order_value": AVERAGE_ORDER,
            "last_order_date": "MAX(last)",
            "first_order_date": "MIN(first)",
            "total_tax_paid": total_of_micros("tax_micros"),
            "total_shipping_paid": total_of_micros("shipping_micros"),
            "active_years": "COUNT(order_year)",
            "active_months": calendar.months_in_masks("months"),
        },
    )


def customer_product_metrics(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Per customer: products and categories bought, items, and the category bought most often.

    Three shrinking aggregations, (customer, product), (customer, category), customer, replace two distinct
    counts and a ranking. Equal counts go to the first category by name.
    """
    per_product = aggregate(
        sales, ["customer_id", "product_id"], {"items": "SUM(quantity)", "lines": "SUM(lines)"}
    )
    per_category = aggregate(
        per_product.join(products.select("product_id", "category"), "product_id"),
        ["customer_id", "category"],
        {"products": "COUNT(*)", "items": "SUM(items)", "lines": "SUM(lines)"},
    )
    return aggregate(
        per_category,
        ["customer_id"],
        {
            "unique_products_bought": "SUM(products)",
            "categories_shopped": "COUNT(category)",
            "total_items_bought": "SUM(items)",
            "favorite_category": "min_by(category, struct(-lines, category))",
        },
    )


def customer_analytics(
    customers: DataFrame,
    orders: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    as_of: date,
    thresholds: Thresholds = Thresholds(),
) -> DataFrame:
    """One row per customer: attributes, order and product metrics, value, recency and frequency segment."""
    joined = (
        customers.select(*CUSTOMER_COLUMNS)
        .join(customer_order_metrics(orders), "customer_id", "left")
        .join(customer_product_metrics(sales, products), "customer_id", "left")
    )
    money = dict.fromkeys(("total_spent", "avg_order_value", "total_tax_paid", "total_shipping_paid"), "0.0D")
    counts = dict.fromkeys(
        (
            "total_orders", "active_years", "active_months",
            "unique_products_bought", "categories_shopped", "total_items_bought",
        ),
        "0",
    )
    idle = calendar.days_until(as_of, "last_order_date")
    return joined.selectExpr(
        *CUSTOMER_COLUMNS,
        *_filled(counts),
        *_filled(money),
        "last_order_date",
        "first_order_date",
        "favorite_category",
        f"{idle} AS days_since_last_order",
        "coalesce(datediff(last_order_date, first_order_date), 0) AS customer_lifespan_days",
        f"{ratio('total_spent', 'total_orders')} AS calculated_aov",
        *_customer_segments(as_of, thresholds),
    )


def _customer_segments(as_of: date, thresholds: Thresholds) -> list[str]:
    idle = calendar.days_until(as_of, "last_order_date")
    segment = {
        "value_segment": segments.at_least(
            "total_spent", zip(thresholds.value, VALUE_LABELS), "Minimal Value", "No Purchase"
        ),
        "recency_segment": "IF(last_order_date IS NULL, 'Never Purchased',"
        f" {segments.up_to(idle, zip(thresholds.recency, RECENCY_LABELS), 'Churned')})",
        "frequency_segment": segments.at_least(
            "total_orders", zip(thresholds.frequency, FREQUENCY_LABELS), "One-time", "No Purchase"
        ),
    }
    return [f"{sql} AS {name}" for name, sql in segment.items()]


def customer_standing(
    customers: DataFrame, orders: DataFrame, as_of: date, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """customer_id and segments alone: what key figures need, without the item reports that the full table joins."""
    joined = customers.select("customer_id").join(customer_order_metrics(orders), "customer_id", "left")
    return joined.selectExpr("customer_id", *_customer_segments(as_of, thresholds))


def product_quantities(products: DataFrame, sales: DataFrame) -> DataFrame:
    """product_id and total_quantity_sold alone, NULL for what was never sold."""
    sold = aggregate(sales, ["product_id"], {"total_quantity_sold": "SUM(quantity)"})
    return products.select("product_id").join(sold, "product_id", "left")


def product_standing(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Per category: its products, how many of them were sold, and the revenue; one pass over the sales lines."""
    per_product = aggregate(sales, ["product_id"], {"quantity": "SUM(quantity)", "revenue_micros": "SUM(revenue_micros)"})
    return aggregate(
        products.select("product_id", "category").join(per_product, "product_id", "left"),
        ["category"],
        {
            "products": "COUNT(*)",
            "products_sold": "count_if(quantity > 0)",
            "lines_found": "COUNT(revenue_micros)",
            "total_revenue": REVENUE,
        },
    )


def customer_order_counts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The short variant: every customer with counts and dates of orders of any status.

    Cleaning leaves each order id once, so the distinct orders are the orders.
    """
    per_customer = aggregate(
        orders,
        ["customer_id"],
        {
            "total_orders": "COUNT(order_id)",
            "unique_orders": "COUNT(order_id)",
            "last_order_date": "MAX(order_date)",
            "first_order_date": "MIN(order_date)",
        },
    )
    columns = ("customer_id", "full_name", "country", "customer_age_group")
    joined = customers.select(*columns).join(per_customer, "customer_id", "left")
    counts = _filled({"total_orders": "0", "unique_orders": "0"})
    return joined.selectExpr(*columns, *counts, "last_order_date", "first_order_date")


# Products --------------------------------------------------------------------------------------


def product_sales(sales: DataFrame) -> DataFrame:
    """Per product: quantity, money, distinct orders and customers, dates.

    A sales line is one (order, product), so orders are counted as rows; adding up per
    (product, customer) first makes customers rows as well.
    """
    per_customer = aggregate(
        sales,
        ["product_id", "customer_id"],
        {
            **{part: f"SUM({part})" for part in LINE_PARTS},
            "orders": "COUNT(*)",
            "last": "MAX(order_date)",
            "first": "MIN(order_date)",
        },
    )
    return aggregate(
        per_customer,
        ["product_id"],
        {
            **_line_sums("total_discounts_given", "total_order_appearances"),
            "unique_orders": "SUM(orders)",
            "unique_customers": "COUNT(customer_id)",
            "last_sold_date": "MAX(last)",
            "first_sold_date": "MIN(first)",
        },
    )


def product_figures(
    products: DataFrame, sales: DataFrame, as_of: date, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """One row per product: attributes, sales, profit, performance and demand; everything but the rank."""
    joined = products.select(*PRODUCT_COLUMNS).join(product_sales(sales), "product_id", "left")
    counts = ("total_quantity_sold", "total_order_appearances", "unique_orders", "unique_customers")
    amounts = ("total_revenue", "total_discounts_given", "avg_selling_price")
    figures = {
        "revenue_per_unit": ratio("total_revenue", "total_quantity_sold"),
        "total_profit": "IF(total_quantity_sold > 0, total_revenue - cost * total_quantity_sold, 0.0D)",
        "avg_quantity_per_order": ratio("total_quantity_sold", "unique_orders"),
        "sales_performance": segments.at_least(
            "total_quantity_sold", zip(thresholds.sales, SALES_LABELS), "Slow Seller", "No Sales"
        ),
        "demand_level": segments.at_least(
            "unique_customers", zip(thresholds.demand, DEMAND_LABELS), "Very Low Demand", "No Demand"
        ),
        "days_since_last_sale": calendar.days_until(as_of, "last_sold_date"),
    }
    return joined.selectExpr(
        *PRODUCT_COLUMNS,
        *_filled(dict.fromkeys(counts, "0")),
        *_filled(dict.fromkeys(amounts, "0.0D")),
        "last_sold_date",
        "first_sold_date",
        *[f"{sql} AS {name}" for name, sql in figures.items()],
    )


def product_analytics(
    products: DataFrame, sales: DataFrame, as_of: date, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """Product figures with revenue_rank, the place among all products; the figures are computed once for both."""
    return computed_once(product_figures(products, sales, as_of, thresholds), with_revenue_rank)


def with_revenue_rank(figures: DataFrame) -> DataFrame:
    """Best over a stored table, as the rank looks at the revenues more than once."""
    return global_rank(figures, "total_revenue", "product_id", "revenue_rank")


# Sales -----------------------------------------------------------------------------------------


def monthly_sales(orders: DataFrame) -> DataFrame:
    """Per month: orders, customers, money, first and last order date, rank by revenue."""
    per_customer = aggregate(
        completed(orders),
        ["order_year", "order_month", "customer_id"],
        {
            **ORDER_PARTS,
            "tax_micros": micros_sum("tax_amount"),
            "shipping_micros": micros_sum("shipping_cost"),
            "first": "MIN(order_date)",
            "last": "MAX(order_date)",
        },
    )
    months = aggregate(
        per_customer,
        ["order_year", "order_month"],
        {
            "total_orders": "SUM(orders)",
            "unique_customers": "COUNT(customer_id)",
            "total_revenue": REVENUE,
            "avg_order_value": AVERAGE_ORDER,
            "total_tax": total_of_micros("tax_micros"),
            "total_shipping": total_of_micros("shipping_micros"),
            "month_start_date": "MIN(first)",
            "month_end_date": "MAX(last)",
        },
    )
    labelled = add(
        months,
        {
            "revenue_rank": small_rank("total_revenue DESC, order_year, order_month"),
            "month_name": calendar.month_name("order_month"),
            "year_month": calendar.year_month("order_year", "order_month"),
        },
    )
    return labelled.orderBy("order_year", "order_month")


def monthly_counts(orders: DataFrame) -> DataFrame:
    """The short variant: completed orders and customers per month."""
    counts = {"total_orders": "COUNT(order_id)", "unique_customers": "COUNT(DISTINCT customer_id)"}
    months = aggregate(completed(orders), ["order_year", "order_month"], counts)
    return months.orderBy("order_year", "order_month")


def category_months(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Per category and month: orders with a line of the category, and the quantity sold.

    Added up per (category, order) first, so orders are rows to count; one category or order may hold most of the lines.
    """
    sold = sales.join(products.select("product_id", "category"), "product_id")
    per_order = aggregate(
        sold.selectExpr("category", "order_id", "quantity", "year(order_date) AS order_year", "month(order_date) AS order_month"),
        ["category", "order_year", "order_month", "order_id"],
        {"quantity": "SUM(quantity)"},
    )
    return aggregate(
        per_order,
        ["category", "order_year", "order_month"],
        {"total_orders": "COUNT(order_id)", "total_quantity_sold": "SUM(quantity)"},
    )


def daily_sales(orders: DataFrame) -> DataFrame:
    day = ["order_date", "order_day_name", "is_weekend"]
    days = aggregate(
        aggregate(completed(orders), [*day, "customer_id"], ORDER_PARTS),
        day,
        {
            "total_orders": "SUM(orders)",
            "unique_customers": "COUNT(customer_id)",
            "total_revenue": REVENUE,
            "avg_order_value": AVERAGE_ORDER,
        },
    )
    return add(days, {"weekday_performance": "IF(is_weekend, 'Weekend', 'Weekday')"}).orderBy("order_date")


def category_sales(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Per category: quantity, money, distinct orders, customers and products, rank by revenue.

    What is to be counted is made into rows: of (customer, order), which also carry the sums, and of products, both from
    one pass over the sales lines. So a category with most of the lines is spread over all tasks; the second copy of a line is a product
    alone, of which each task keeps one.
    """
    sold = sales.join(products.select("product_id", "category"), "product_id")
    no_sums = ", ".join("NULL" for _ in LINE_PARTS)
    kept = sold.selectExpr(
        "category",
        f"stack(2, true, customer_id, order_id, {', '.join(LINE_PARTS)}, false, product_id, NULL, {no_sums})"
        f" AS (is_order, one, two, {', '.join(LINE_PARTS)})",
    )
    sums = {part: f"SUM({part})" for part in LINE_PARTS}
    per_order = aggregate(kept, ["category", "is_order", "one", "two"], sums)
    # An order has one customer, so orders are counted on the way to customers.
    per_customer = aggregate(per_order, ["category", "is_order", "one"], {**sums, "orders": "COUNT(two)"})
    totals = aggregate(
        per_customer,
        ["category"],
        {
            **_line_sums("total_discounts", "total_items"),
            "unique_products": "COUNT(IF(is_order, NULL, one))",
            "unique_orders": "SUM(orders)",
            "unique_customers": "COUNT(IF(is_order, one, NULL))",
        },
    )
    ranked = add(
        totals,
        {
            "revenue_rank": small_rank("total_revenue DESC, category"),
            "avg_revenue_per_product": ratio("total_revenue", "unique_products"),
        },
    )
    return ranked.orderBy("revenue_rank")


# Cohorts ---------------------------------------------------------------------------------------


def customer_days(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Completed orders per known customer and day, with the day of the first purchase.

    The grain bounds what one customer can hold (days, not orders), so the first purchase is a window
    over it and no second pass over the orders is needed.
    """
    days = aggregate(
        completed(orders),
        ["customer_id", "order_date"],
        {"revenue_micros": micros_sum("order_total"), "orders": "COUNT(order_id)"},
    )
    known = days.join(customers.select("customer_id"), "customer_id", "left_semi")
    return add(
        known,
        {"first_purchase_date": "MIN(order_date) OVER (PARTITION BY customer_id)"},
    ).selectExpr(
        "*",
        f"{calendar.year_month('year(first_purchase_date)', 'month(first_purchase_date)')} AS cohort_month",
    )


def cohort_sizes(days: DataFrame) -> DataFrame:
    """Customers per cohort: each has exactly one row for the day of the first purchase."""
    starters = days.filter("order_date = first_purchase_date")
    return aggregate(starters, ["cohort_month"], {"cohort_size": "COUNT(*)"})


def _cohorts(days: DataFrame, age: str) -> DataFrame:
    """Activity per cohort and age; the cohort size is summed from the rows of first purchases."""
    group = ["cohort_month", "months_since_first_purchase"]
    per_customer = aggregate(
        add(days, {"months_since_first_purchase": age}),
        [*group, "customer_id"],
        {
            "revenue_micros": "SUM(revenue_micros)",
            "orders": "SUM(orders)",
            "starters": "count_if(order_date = first_purchase_date)",
        },
    )
    activity = aggregate(
        per_customer,
        group,
        {
            "active_customers": "COUNT(customer_id)",
            "cohort_revenue": REVENUE,
            "cohort_orders": "SUM(orders)",
            "starters": "SUM(starters)",
        },
    )
    # Bounded window: a cohort has at most one row per day of the calendar.
    sized = add(activity, {"cohort_size": "SUM(starters) OVER (PARTITION BY cohort_month)"})
    return sized.selectExpr(
        "cohort_month",
        "months_since_first_purchase",
        "cohort_size",
        "active_customers",
        f"{percent('active_customers', 'cohort_size')} AS retention_rate",
        "cohort_revenue",
        "round(cohort_revenue / active_customers, 2) AS revenue_per_customer",
        "cohort_orders",
    ).orderBy("cohort_month", "months_since_first_purchase")


def cohort_analysis(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Cohorts by fractional months since the first purchase (eight digits, close to one row per day)."""
    return _cohorts(customer_days(customers, orders), "months_between(order_date, first_purchase_date)")


def cohort_by_month(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Cohorts by full months since the first purchase: the table a retention matrix needs."""
    full_months = "CAST(floor(months_between(order_date, first_purchase_date)) AS INT)"
    return _cohorts(customer_days(customers, orders), full_months)
