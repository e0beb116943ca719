"""Cleaning, one hand-written row per edge."""

from datetime import date

import pytest

from tradewind.config import Thresholds
from tradewind.plans import silver

CUSTOMERS = (
    "customer_id string, first_name string, last_name string, email string, registration_date date, country string,"
    " city string, age int, seq int"
)
PRODUCTS = (
    "product_id string, product_name string, category string, sub_category string, brand string, price double, cost double,"
    " weight_kg double, dimensions string, in_stock boolean, stock_quantity int, supplier string"
)
ORDERS = (
    "order_id string, customer_id string, order_date date, status string, payment_method string, shipping_method string,"
    " order_total double, tax_amount double, shipping_cost double"
)
ITEMS = (
    "order_item_id string, order_id string, product_id string, quantity int, unit_price double, line_total double,"
    " discount_amount double"
)
DAY = date(2024, 1, 1)


def by_key(df, key):
    return {row[key]: row for row in df.collect()}


def customer(key, age=30, email="x@y.com", day=DAY, first=" ann MARIE", last="o'neil ", seq=0):
    return (key, first, last, email, day, " Italy ", " new YORK ", age, seq)


def product(key, price=100.0, cost=40.0, weight=2.0, dims="10x20x30 cm", stock=True, quantity=50):
    return (key, " red PEN", " home  goods ", "pens", "acme", price, cost, weight, dims, stock, quantity, "THE supplier")


def order(key, day=DAY, status="completed", total=10.0, tax=1.0, ship=2.0, customer_id="c"):
    return (key, customer_id, day, status, " credit CARD", "next-day air", total, tax, ship)


def item(key, quantity=2, price=5.0, total=10.0, discount=0.0):
    return (key, "o", "p", quantity, price, total, discount)


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        *[customer(f"age{a}", age=a) for a in (17, 18, 24, 25, 34, 35, 44, 45, 54, 55, 100, 101)],
        customer("no_age", age=None),
        customer("no_mail", email=None),
        customer(None),
        customer("mixed", email="  Some.One@Example.COM "),
        customer("no_at", email="nobody"),
        customer("new", day=date(2024, 6, 2)),
        customer("active_low", day=date(2024, 6, 1)),
        customer("active_high", day=date(2023, 7, 3)),
        customer("loyal", day=date(2023, 7, 2)),
        customer("undated", day=None),
        customer("half_name", last=None),
        customer("twice", first="late", seq=2),
        customer("twice", first="early", seq=1),
    ]
    return by_key(silver.clean_customers(spark.createDataFrame(rows, CUSTOMERS), date(2024, 7, 1), ["seq"]), "customer_id")


def test_customer_filters(customers):
    assert not {"age17", "age101", "no_age", "no_mail", None} & set(customers)
    assert {"age18", "age100"} <= set(customers)


def test_customer_age_groups(customers):
    groups = {a: customers[f"age{a}"].customer_age_group for a in (18, 24, 25, 34, 35, 44, 45, 54, 55, 100)}
    assert groups == {
        18: "18-24", 24: "18-24", 25: "25-34", 34: "25-34", 35: "35-44", 44: "35-44", 45: "45-54", 54: "45-54",
        55: "55+", 100: "55+",
    }


def test_customer_lifetime_edges(customers):
    days = {k: customers[k].days_since_registration for k in ("new", "active_low", "active_high", "loyal", "undated")}
    assert days == {"new": 29, "active_low": 30, "active_high": 364, "loyal": 365, "undated": None}
    labels = [customers[k].customer_lifetime_category for k in ("new", "active_low", "active_high", "loyal", "undated")]
    assert labels == ["New", "Active", "Active", "Loyal", "Loyal"]


def test_customer_text_is_enriched_before_it_is_standardized(customers):
    row = customers["mixed"]
    assert row.full_name == " ann MARIE o'neil "
    assert row.email_domain == "Example.COM "
    assert (row.first_name, row.last_name, row.city, row.country) == ("Ann Marie", "O'neil", "New York", "Italy")
    assert row.email == "some.one@example.com"
    assert customers["no_at"].email_domain == ""
    assert customers["half_name"].full_name is None


def test_customer_survivor_is_the_first_by_order(customers):
    assert customers["twice"].first_name == "Early"


def test_customer_metadata(customers):
    row = customers["mixed"]
    assert row.data_quality_score == 95
    assert row.cleaning_rules_applied == ["null_removal", "age_validation", "deduplication", "text_standardization"]
    assert row.silver_processed_timestamp.date() == row.silver_processed_date


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        *[product(f"price{p}", price=p, cost=1.0) for p in (49.99, 50.0, 199.99, 200.0, 499.99, 500.0)],
        *[product(f"weight{w}", weight=w) for w in (0.99, 1.0, 4.99, 5.0, 19.99, 20.0)],
        product("no_weight", weight=None),
        product("free", price=0.0),
        product("no_cost", cost=0.0),
        product("at_loss", price=10.0, cost=10.01),
        product("even", price=10.0, cost=10.0),
        product(None),
        product("plenty", quantity=11),
        product("low", quantity=10),
        product("last", quantity=1),
        product("empty", quantity=0),
        product("delisted", stock=False),
        product("unknown_stock", stock=None),
        product("two_sides", dims="10x20"),
        product("words", dims="n/a"),
        product("no_dims", dims=None),
        product("copy"),
        product("copy"),
    ]
    return by_key(silver.clean_products(spark.createDataFrame(rows, PRODUCTS)), "product_id")


def test_product_filters_and_copies(products):
    assert not {"free", "no_cost", "at_loss", None} & set(products)
    assert products["even"].profit_amount == 0.0
    assert "copy" in products


def test_product_classes(products):
    assert [products[f"price{p}"].price_category for p in (49.99, 50.0, 199.99, 200.0, 499.99, 500.0)] == [
        "Budget", "Mid-Range", "Mid-Range", "Premium", "Premium", "Luxury",
    ]
    assert [products[f"weight{w}"].weight_category for w in (0.99, 1.0, 4.99, 5.0, 19.99, 20.0)] == [
        "Light", "Medium", "Medium", "Heavy", "Heavy", "Very Heavy",
    ]
    assert products["no_weight"].weight_category == "Very Heavy"
    stock = ("plenty", "low", "last", "empty", "delisted", "unknown_stock")
    assert [products[k].availability_status for k in stock] == [
        "Available", "Low Stock", "Low Stock", "Out of Stock", "Out of Stock", "Out of Stock",
    ]


def test_product_margin(products):
    row = products["plenty"]
    assert (row.profit_margin_pct, row.profit_amount) == (60.0, 60.0)


def test_product_dimensions(products):
    def box(key):
        row = products[key]
        return row.length_cm, row.width_cm, row.height_cm, row.volume_cm3

    assert box("plenty") == (10.0, 20.0, 30.0, 6000.0)
    assert box("two_sides") == (10.0, 20.0, None, None)
    assert box("words") == (None, None, None, None)
    assert box("no_dims") == (None, None, None, None)
    assert "dimensions_parsed" not in products["plenty"].asDict()


def test_product_text(products):
    row = products["plenty"]
    assert (row.product_name, row.category, row.supplier) == ("Red Pen", "Home  Goods", "The Supplier")
    assert row.data_quality_score == 92


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        *[order(f"total{t}", total=t) for t in (0.0, 49.99, 50.0, 149.99, 150.0, 299.99, 300.0)],
        *[order(f"month{m}", day=date(2023, m, 15)) for m in range(1, 13)],
        *[order(f"day{d}", day=date(2024, 6, d)) for d in range(2, 9)],  # Sunday to Saturday
        order("negative", total=-0.01),
        order("no_total", total=None),
        order("undated", day=None),
        order("nobody", customer_id=None),
        order(None),
        order("odd_status", status="returned"),
        order("other_case", status="Completed"),
        order("padded", status="completed "),
        order("pending", status="pending"),
        order("cancelled", status="cancelled"),
        order("no_tax", tax=None),
        order("recent", day=date(2024, 6, 1)),
        order("old", day=date(2024, 5, 31)),
    ]
    return by_key(silver.clean_orders(spark.createDataFrame(rows, ORDERS), date(2024, 7, 1)), "order_id")


def test_order_filters(orders):
    gone = {"negative", "no_total", "undated", "nobody", None, "odd_status", "other_case", "padded"}
    assert not gone & set(orders)
    assert {"pending", "cancelled", "total0.0"} <= set(orders)


def test_order_values(orders):
    totals = (0.0, 49.99, 50.0, 149.99, 150.0, 299.99, 300.0)
    assert [orders[f"total{t}"].order_value_category for t in totals] == [
        "Small", "Small", "Medium", "Medium", "Large", "Large", "XLarge",
    ]
    assert orders["total50.0"].total_order_amount == 53.0
    assert orders["no_tax"].total_order_amount is None


def test_order_thresholds_are_settings(spark):
    df = spark.createDataFrame([order("o", total=40.0)], ORDERS)
    cleaned = silver.clean_orders(df, date(2024, 7, 1), Thresholds(order_value=(10.0, 20.0, 30.0)))
    assert cleaned.first().order_value_category == "XLarge"


def test_order_calendar(orders):
    seasons = [orders[f"month{m}"].season for m in range(1, 13)]
    assert seasons == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    assert [m for m in range(1, 13) if orders[f"month{m}"].is_holiday_season] == [11, 12]
    assert [orders[f"month{m}"].order_quarter for m in (1, 4, 7, 10)] == [1, 2, 3, 4]
    names = [orders[f"day{d}"].order_day_name for d in range(2, 9)]
    assert names == ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    assert [orders[f"day{d}"].order_day_of_week for d in range(2, 9)] == list(range(1, 8))
    assert [orders[f"day{d}"].is_weekend for d in range(2, 9)] == [True] + [False] * 5 + [True]
    row = orders["month3"]
    assert (row.order_year, row.order_month) == (2023, 3)


def test_order_recency(orders):
    assert (orders["recent"].days_since_order, orders["recent"].is_recent_order) == (30, True)
    assert (orders["old"].days_since_order, orders["old"].is_recent_order) == (31, False)


def test_order_text(orders):
    row = orders["recent"]
    assert (row.payment_method, row.shipping_method) == ("Credit Card", "Next-day Air")


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        *[item(f"quantity{q}", quantity=q, price=5.0, total=5.0 * q) for q in (1, 2, 3, 4, 5, 6)],
        *[item(f"price{p}", quantity=1, price=p, total=p) for p in (24.99, 25.0, 99.99, 100.0, 299.99, 300.0)],
        item("close", total=10.005),
        item("off", total=10.02),
        item("zero_total", total=0.0, discount=1.0),
        item("no_discount"),
        item("small", discount=0.49),
        item("medium_low", discount=0.5),
        item("medium_high", discount=1.49),
        item("large", discount=1.5),
        item("unknown_discount", discount=None),
        item("negative_discount", discount=-1.0),
        item("none", quantity=0),
        item("gift", price=0.0),
        item("refund", total=-1.0),
        item(None),
    ]
    return by_key(silver.clean_order_items(spark.createDataFrame(rows, ITEMS)), "order_item_id")


def test_item_filters(items):
    assert not {"none", "gift", "refund", None} & set(items)


def test_item_totals(items):
    assert items["close"].line_total_corrected == 10.005
    assert items["off"].line_total_corrected == 10.0
    assert items["off"].final_amount == 10.02  # from the total as it came
    assert items["zero_total"].line_total_corrected == 10.0
    assert "calculated_line_total" not in items["off"].asDict()


def test_item_discounts(items):
    keys = ("zero_total", "no_discount", "small", "medium_low", "medium_high", "large", "unknown_discount", "negative_discount")
    assert [items[k].discount_rate for k in keys] == [0.0, 0.0, 4.9, 5.0, 14.9, 15.0, None, -10.0]
    assert [items[k].discount_category for k in keys] == [
        "No Discount", "No Discount", "Small", "Medium", "Medium", "Large", "Large", "Small",
    ]
    assert [items[k].has_discount for k in keys] == [True, False, True, True, True, True, None, False]


def test_item_classes(items):
    assert [items[f"quantity{q}"].quantity_category for q in (1, 2, 3, 4, 5, 6)] == [
        "Single", "Few", "Few", "Multiple", "Multiple", "Bulk",
    ]
    assert [items[f"price{p}"].unit_price_category for p in (24.99, 25.0, 99.99, 100.0, 299.99, 300.0)] == [
        "Budget", "Standard", "Standard", "Premium", "Premium", "Luxury",
    ]


@pytest.mark.parametrize(
    ("schema", "clean"),
    [
        (CUSTOMERS, lambda df: silver.clean_customers(df, DAY)),
        (PRODUCTS, silver.clean_products),
        (ORDERS, lambda df: silver.clean_orders(df, DAY)),
        (ITEMS, silver.clean_order_items),
    ],
)
def test_empty_input_gives_empty_output(spark, schema, clean):
    assert clean(spark.createDataFrame([], schema)).count() == 0


def test_a_renamed_source_column_is_an_error(spark, small_dir, tmp_path):
    from tradewind.sources import retail

    for table in ("part", "orders"):
        df = spark.read.parquet(f"{small_dir}/{table}.parquet")
        (df.withColumnRenamed("p_brand", "brand") if table == "part" else df).write.parquet(str(tmp_path / f"{table}.parquet"))
    with pytest.raises(ValueError, match="p_brand"):
        retail.raw_products(spark, str(tmp_path))
    assert retail.raw_orders(spark, str(tmp_path)).count() > 0
