"""Gold tables from a handful of cleaned rows worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tradewind.config import Thresholds
from tradewind.plans import forecast, gold, insights, kpis, silver

AS_OF = date(2024, 7, 1)
CUSTOMERS = (
    "customer_id string, first_name string, last_name string, email string, registration_date date, country string,"
    " city string, age int, customer_segment string"
)


def d(text):
    return date.fromisoformat(text)


@pytest.fixture(scope="module")
def cleaned(spark):
    people = [
        (k, k, "X", f"{k}@x.com", d("2023-01-01"), c, "Town", age, "Standard")
        for k, c, age in (("a", "Italy", 20), ("b", "Spain", 30), ("c", "Italy", 40), ("idle", "Spain", 60))
    ]
    goods = [
        (k, k, cat, cat, "Acme", price, cost, 1.0, "1x2x3", True, 5, "S")
        for k, cat, price, cost in (("pen", "office", 2.0, 1.0), ("desk", "office", 200.0, 150.0), ("ball", "sport", 20.0, 5.0), ("unsold", "sport", 9.0, 3.0))
    ]
    orders = [
        ("o1", "a", d("2024-01-31"), "completed", "card", "air", 100.0, 8.0, 5.0),
        ("o2", "a", d("2024-02-29"), "completed", "card", "air", 500.5, 40.0, 5.0),
        ("o3", "a", d("2024-06-20"), "completed", "card", "air", 600.0, 48.0, 5.0),
        ("o4", "b", d("2023-02-10"), "completed", "card", "air", 99.0, 8.0, 5.0),
        ("o5", "c", d("2024-02-10"), "pending", "card", "air", 70.0, 5.0, 0.0),
        ("o6", "ghost", d("2024-02-10"), "completed", "card", "air", 10.0, 1.0, 1.0),
    ]
    lines = [
        ("i1", "o1", "pen", 10, 2.0, 20.0, 1.0),
        ("i2", "o1", "pen", 5, 2.0, 10.0, None),
        ("i3", "o1", "ball", 1, 20.0, 20.0, 0.0),
        ("i4", "o2", "ball", 2, 20.0, 40.0, 2.0),
        ("i5", "o4", "desk", 1, 200.0, 200.0, 0.0),
        ("i6", "o5", "desk", 1, 200.0, 200.0, 0.0),  # not completed
        ("i7", "o3", "missing", 1, 5.0, 5.0, 0.0),  # product not in the catalog
    ]
    product_schema = (
        "product_id string, product_name string, category string, sub_category string, brand string, price double,"
        " cost double, weight_kg double, dimensions string, in_stock boolean, stock_quantity int, supplier string"
    )
    order_schema = (
        "order_id string, customer_id string, order_date date, status string, payment_method string, shipping_method string,"
        " order_total double, tax_amount double, shipping_cost double"
    )
    item_schema = (
        "order_item_id string, order_id string, product_id string, quantity int, unit_price double, line_total double,"
        " discount_amount double"
    )
    return {
        "customers": silver.clean_customers(spark.createDataFrame(people, CUSTOMERS), AS_OF),
        "products": silver.clean_products(spark.createDataFrame(goods, product_schema)),
        "orders": silver.clean_orders(spark.createDataFrame(orders, order_schema), AS_OF),
        "order_items": silver.clean_order_items(spark.createDataFrame(lines, item_schema)),
    }


@pytest.fixture(scope="module")
def sales(cleaned):
    return gold.sales_lines(cleaned["orders"], cleaned["order_items"])


@pytest.fixture(scope="module")
def customers(cleaned, sales):
    df = gold.customer_analytics(cleaned["customers"], cleaned["orders"], sales, cleaned["products"], AS_OF)
    return {r.customer_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def products(cleaned, sales):
    return {r.product_id: r for r in gold.product_analytics(cleaned["products"], sales, AS_OF).collect()}


def test_sales_lines_are_one_row_per_order_and_product(sales):
    rows = {(r.order_id, r.product_id): r for r in sales.collect()}
    assert set(rows) == {("o1", "pen"), ("o1", "ball"), ("o2", "ball"), ("o4", "desk"), ("o3", "missing")}
    pen = rows["o1", "pen"]
    assert (pen.quantity, pen.revenue_micros, pen.discount_micros, pen.lines, pen.customer_id) == (15, 30_000_000, 1_000_000, 2, "a")


def test_customer_order_metrics(customers):
    a = customers["a"]
    assert (a.total_orders, a.total_spent, a.avg_order_value) == (3, 1200.5, 1200.5 / 3)
    assert (a.total_tax_paid, a.total_shipping_paid) == (96.0, 15.0)
    assert (a.active_years, a.active_months) == (1, 3)
    assert (a.first_order_date, a.last_order_date) == (d("2024-01-31"), d("2024-06-20"))
    assert (a.days_since_last_order, a.customer_lifespan_days) == (11, 141)
    assert a.calculated_aov == 1200.5 / 3


def test_customer_product_metrics(customers):
    a = customers["a"]
    assert (a.unique_products_bought, a.categories_shopped, a.total_items_bought) == (2, 2, 18)
    # Two lines of each category: the first name wins.
    assert a.favorite_category == "Office"


def test_customers_without_completed_orders(customers):
    for key in ("c", "idle"):
        row = customers[key]
        assert (row.total_orders, row.total_spent, row.avg_order_value, row.active_years) == (0, 0.0, 0.0, 0)
        assert (row.last_order_date, row.days_since_last_order, row.favorite_category) == (None, None, None)
        assert (row.customer_lifespan_days, row.calculated_aov) == (0, 0.0)
        assert (row.value_segment, row.recency_segment, row.frequency_segment) == (
            "No Purchase", "Never Purchased", "No Purchase",
        )
    assert "ghost" not in customers


def test_customer_segments(customers):
    assert [customers[k].value_segment for k in ("a", "b")] == ["High Value", "Minimal Value"]
    assert [customers[k].recency_segment for k in ("a", "b")] == ["Recent", "Churned"]
    assert [customers[k].frequency_segment for k in ("a", "b")] == ["Occasional", "One-time"]


def _single_customer_orders(spark, spec):
    """One order per (key, total, days before AS_OF)."""
    rows = [
        (f"{k}-{n}", k, date.fromordinal(AS_OF.toordinal() - back), "completed", "x", "y", total, 0.0, 0.0)
        for k, total, back, times in spec
        for n in range(times)
    ]
    schema = (
        "order_id string, customer_id string, order_date date, status string, payment_method string, shipping_method string,"
        " order_total double, tax_amount double, shipping_cost double"
    )
    return silver.clean_orders(spark.createDataFrame(rows, schema), AS_OF)


def test_every_segment_edge(spark, cleaned):
    spec = [
        ("v1000", 1000.0, 30, 1), ("v999", 999.99, 31, 1), ("v500", 500.0, 90, 1), ("v499", 499.99, 91, 1),
        ("v100", 100.0, 365, 1), ("v99", 99.99, 366, 1), ("v0", 0.0, 1, 1), ("f2", 1.0, 1, 2), ("f4", 1.0, 1, 4),
        ("f5", 1.0, 1, 5), ("f9", 1.0, 1, 9), ("f10", 1.0, 1, 10),
    ]
    orders = _single_customer_orders(spark, spec)
    people = [(k, "A", "B", "m@x.com", d("2020-01-01"), "X", "Y", 30, "S") for k, *_ in spec]
    customers = silver.clean_customers(spark.createDataFrame(people, CUSTOMERS), AS_OF)
    nothing = gold.sales_lines(orders, cleaned["order_items"])
    rows = {r.customer_id: r for r in gold.customer_analytics(customers, orders, nothing, cleaned["products"], AS_OF).collect()}
    assert {k: rows[k].value_segment for k in ("v1000", "v999", "v500", "v499", "v100", "v99", "v0")} == {
        "v1000": "High Value", "v999": "Medium Value", "v500": "Medium Value", "v499": "Low Value", "v100": "Low Value",
        "v99": "Minimal Value", "v0": "No Purchase",
    }
    assert {k: rows[k].recency_segment for k in ("v1000", "v999", "v500", "v499", "v100", "v99")} == {
        "v1000": "Recent", "v999": "Active", "v500": "Active", "v499": "At Risk", "v100": "At Risk", "v99": "Churned",
    }
    assert {k: rows[k].frequency_segment for k in ("v0", "f2", "f4", "f5", "f9", "f10")} == {
        "v0": "One-time", "f2": "Occasional", "f4": "Occasional", "f5": "Regular", "f9": "Regular", "f10": "Frequent",
    }


def test_product_figures(products):
    pen = products["pen"]
    assert (pen.total_quantity_sold, pen.total_revenue, pen.total_discounts_given) == (15, 30.0, 1.0)
    assert (pen.total_order_appearances, pen.unique_orders, pen.unique_customers) == (2, 1, 1)
    assert (pen.avg_selling_price, pen.revenue_per_unit, pen.total_profit) == (2.0, 2.0, 15.0)
    assert pen.avg_quantity_per_order == 15.0
    assert (pen.sales_performance, pen.demand_level) == ("Average Seller", "Very Low Demand")
    assert products["desk"].total_quantity_sold == 1  # the pending order does not count
    assert products["desk"].days_since_last_sale == (AS_OF - d("2023-02-10")).days


def test_unsold_product(products):
    row = products["unsold"]
    assert (row.total_quantity_sold, row.total_revenue, row.revenue_per_unit, row.total_profit) == (0, 0.0, 0.0, 0.0)
    assert (row.last_sold_date, row.days_since_last_sale) == (None, None)
    assert (row.sales_performance, row.demand_level) == ("No Sales", "No Demand")


def test_revenue_rank(products):
    assert [k for k, _ in sorted(products.items(), key=lambda kv: kv[1].revenue_rank)] == ["desk", "ball", "pen", "unsold"]


def test_monthly_sales(cleaned):
    rows = gold.monthly_sales(cleaned["orders"]).collect()
    assert [(r.year_month, r.month_name, r.total_orders, r.total_revenue, r.revenue_rank) for r in rows] == [
        ("2023-02", "February", 1, 99.0, 4), ("2024-01", "January", 1, 100.0, 3),
        ("2024-02", "February", 2, 510.5, 2), ("2024-06", "June", 1, 600.0, 1),
    ]
    assert rows[2].unique_customers == 2 and rows[2].avg_order_value == 255.25
    assert (rows[2].month_start_date, rows[2].month_end_date) == (d("2024-02-10"), d("2024-02-29"))


def test_daily_sales(cleaned):
    rows = {r.order_date: r for r in gold.daily_sales(cleaned["orders"]).collect()}
    assert len(rows) == 5
    assert rows[d("2024-02-10")].weekday_performance == "Weekend"
    assert rows[d("2024-01-31")].order_day_name == "Wednesday"


def test_category_sales(cleaned, sales):
    rows = {r.category: r for r in gold.category_sales(sales, cleaned["products"]).collect()}
    office = rows["Office"]
    assert (office.total_quantity_sold, office.total_revenue, office.total_items) == (16, 230.0, 3)
    assert (office.unique_orders, office.unique_customers, office.unique_products) == (2, 2, 2)
    assert (office.avg_selling_price, office.total_discounts) == (68.0, 1.0)
    assert (office.revenue_rank, office.avg_revenue_per_product) == (1, 115.0)


def test_cohorts_keep_fractional_and_full_months_apart(cleaned):
    fractional = [
        (r.cohort_month, r.months_since_first_purchase, r.cohort_size, r.active_customers, r.retention_rate, r.cohort_revenue)
        for r in gold.cohort_analysis(cleaned["customers"], cleaned["orders"]).collect()
    ]
    assert fractional == [
        ("2023-02", 0.0, 1, 1, 100.0, 99.0),
        ("2024-01", 0.0, 1, 1, 100.0, 100.0),
        ("2024-01", 1.0, 1, 1, 100.0, 500.5),  # last day to last day is a full month
        ("2024-01", 4.64516129, 1, 1, 100.0, 600.0),
    ]
    full = gold.cohort_by_month(cleaned["customers"], cleaned["orders"]).collect()
    assert [(r.cohort_month, r.months_since_first_purchase) for r in full] == [("2023-02", 0), ("2024-01", 0), ("2024-01", 1), ("2024-01", 4)]
    matrix = insights.retention_matrix(gold.cohort_by_month(cleaned["customers"], cleaned["orders"]))
    assert [tuple(r) for r in matrix.collect()] == [("2023-02", {0: 100.0}), ("2024-01", {0: 100.0, 1: 100.0, 4: 100.0})]


def test_short_customer_variant_counts_every_status(cleaned):
    rows = {r.customer_id: r for r in gold.customer_order_counts(cleaned["customers"], cleaned["orders"]).collect()}
    assert (rows["c"].total_orders, rows["idle"].total_orders, rows["idle"].last_order_date) == (1, 0, None)


def test_kpis(spark, cleaned, sales):
    c = gold.customer_analytics(cleaned["customers"], cleaned["orders"], sales, cleaned["products"], AS_OF)
    p = gold.product_figures(cleaned["products"], sales, AS_OF)
    df = kpis.business_kpis(c, p, gold.monthly_sales(cleaned["orders"]), gold.category_sales(sales, cleaned["products"]))
    values = {r.metric_name: r.metric_value for r in df.collect()}
    assert values == {
        "Total Customers": "4", "Active Customers": "1", "Customer Activation Rate": "25.0", "High Value Customers": "1",
        "Total Revenue": "1309.5", "Total Orders": "5", "Average Order Value": "261.9", "Total Products": "4",
        "Products with Sales": "3", "Product Sales Rate": "75.0", "Top Category": "Office",
    }
    stored = kpis.stamped_kpis(df)
    assert stored.columns == ["metric_name", "metric_value", "metric_type", "category", "kpi_date", "kpi_timestamp"]
    none = kpis.business_kpis(c.limit(0), p.limit(0), gold.monthly_sales(cleaned["orders"]).limit(0), gold.category_sales(sales, cleaned["products"]).limit(0))
    empty = {r.metric_name: r.metric_value for r in none.collect()}
    assert empty["Total Customers"] == "0" and empty["Top Category"] == "N/A" and empty["Customer Activation Rate"] == "0.0"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 4.9, 5, 50, 100)] + [(None,)], "avg_order_value double")
    rows = {r.bin: (r.bin_start, r.bin_end, r.customer_count) for r in insights.order_value_histogram(df).collect()}
    assert rows == {1: (0.0, 5.0, 2), 2: (5.0, 10.0, 1), 11: (50.0, 55.0, 1), 20: (95.0, 100.0, 1)}
    same = spark.createDataFrame([(7.0,), (7.0,)], "avg_order_value double")
    assert [(r.bin, r.customer_count) for r in insights.order_value_histogram(same).collect()] == [(1, 2)]


def test_thresholds_are_settings(cleaned, sales):
    custom = Thresholds(value=(5000.0, 4000.0, 3000.0), sales=(16, 15, 1), demand=(2, 1, 1))
    c = gold.customer_analytics(cleaned["customers"], cleaned["orders"], sales, cleaned["products"], AS_OF, custom)
    assert {r.customer_id: r.value_segment for r in c.collect()}["a"] == "Minimal Value"
    p = {r.product_id: r for r in gold.product_figures(cleaned["products"], sales, AS_OF, custom).collect()}
    assert (p["pen"].sales_performance, p["pen"].demand_level) == ("Good Seller", "Medium Demand")


def test_forecast_finds_an_exact_line(spark):
    rows = [(2020 + n // 12, n % 12 + 1, 3 * n + 10) for n in range(40)]
    months = spark.createDataFrame(rows, "order_year int, order_month int, total_orders bigint")
    split = forecast.with_split(forecast.with_month_number(months))
    assert split.filter("is_train").count() == 32
    line = forecast.fit_line(split).first()
    assert round(line.slope, 9) == 3.0 and line.months == 32
    predicted = forecast.predict(split)
    assert predicted.count() == 8
    assert forecast.rmse(predicted).first().rmse < 1e-6
    model = forecast.model_predictions(split)
    assert model.count() == 8 and forecast.model_rmse(model) < 1e-5


def test_forecast_per_group(spark):
    rows = [(g, 2020 + n // 12, n % 12 + 1, k * n) for g, k in (("x", 2), ("y", 5)) for n in range(20)]
    months = spark.createDataFrame(rows, "category string, order_year int, order_month int, total_orders bigint")
    split = forecast.with_split(forecast.with_month_number(months))
    lines = {r.category: round(r.slope, 9) for r in forecast.fit_line(split, ["category"]).collect()}
    assert lines == {"x": 2.0, "y": 5.0}
    assert forecast.rmse(forecast.predict(split, ["category"])).first().rmse < 1e-6


def test_lines_per_group_come_from_sums_that_add_up(spark):
    """Against numpy; sums of two halves of the months, stored apart, give the lines of the whole."""
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(g, 1998 + m // 12, m % 12 + 1, rng.randrange(10**12)) for g, n in (("a", 40), ("b", 25), (None, 9), ("one", 1)) for m in range(n)]
    months = forecast.with_month_number(spark.createDataFrame(rows, "category string, order_year int, order_month int, total_orders bigint"))
    split = forecast.with_split(months, by=["category"])
    sums = forecast.regression_sums(split, ["category"])
    halves = sums.filter("month_numeric % 2 = 0").unionAll(sums.filter("month_numeric % 2 = 1"))
    merged = halves.groupBy("category").agg(*[F.sum(c).alias(c) for c in forecast.SUMS])
    lines = {r.category: r for r in forecast.lines_of_sums(sums, ["category"]).collect()}
    assert lines == {r.category: r for r in forecast.lines_of_sums(merged, ["category"]).collect()}
    train = {}
    for r in split.collect():
        if r.is_train:
            train.setdefault(r.category, []).append((r.month_numeric, r.total_orders))
    assert lines["one"].slope is None and {k: len(v) for k, v in train.items()} == {k: r.months for k, r in lines.items()}
    for g in ("a", "b", None):
        slope, intercept = np.polyfit(*np.array(train[g], float).T, 1)
        assert np.isclose(lines[g].slope, slope, rtol=1e-6) and np.isclose(lines[g].intercept, intercept, rtol=1e-6)
    errors = {r.category: r for r in forecast.rmse(forecast.predict(split, ["category"]), ["category"]).collect()}
    held = [r for r in split.collect() if r.category == "a" and not r.is_train]
    expected = np.sqrt(np.mean([(r.total_orders - lines["a"].slope * r.month_numeric - lines["a"].intercept) ** 2 for r in held]))
    assert np.isclose(errors["a"].rmse, expected) and errors["a"].test_months == len(held) == 8
    assert {"a", "b", None} <= set(errors)  # a group without a name has its line too


def test_category_months_count_orders_once(cleaned, sales):
    rows = {(r.category, r.order_year, r.order_month): r.total_orders for r in gold.category_months(sales, cleaned["products"]).collect()}
    joined = sales.join(cleaned["products"].select("product_id", "category"), "product_id").collect()
    expected = {}
    for r in joined:
        expected.setdefault((r.category, r.order_date.year, r.order_date.month), set()).add(r.order_id)
    assert rows == {k: len(v) for k, v in expected.items()}
