"""Silver: filtered, deduplicated, enriched and standardized tables.

The order of the steps is part of the result: filters, then one row per key, then enrichment on
the text as it came, then standardized text. Only raw columns cross the deduplication shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame

from tradewind.config import Thresholds
from tradewind.functions import calendar, segments
from tradewind.functions.sql import add, array_of, replace, text
from tradewind.functions.text import dimension, title
from tradewind.operators.dedup import first_per_key

# Statuses, labels and edges of the cleaned tables, and their declared scores and rules.
STATUSES = ("completed", "pending", "cancelled")
AGE_GROUPS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"))
LIFETIME = ((30, "New"), (365, "Active"))
PRICE_CLASSES = ((50, "Budget"), (200, "Mid-Range"), (500, "Premium"))
WEIGHT_CLASSES = ((1, "Light"), (5, "Medium"), (20, "Heavy"))
DISCOUNT_CLASSES = ((5, "Small"), (15, "Medium"))
ORDER_VALUES = ("Small", "Medium", "Large")
UNIT_PRICES = ("Budget", "Standard", "Premium")
QUANTITIES = ((1, "Single"), (3, "Few"), (5, "Multiple"))
PLENTY_IN_STOCK = 10
RECENT_DAYS = 30
TOTAL_TOLERANCE = 0.01
WEEKEND = (1, 7)
HOLIDAY_MONTHS = (11, 12)
QUALITY_SCORES = {"customers": 95, "products": 92, "orders": 90, "order_items": 88}
CLEANING_RULES = {
    "customers": ("null_removal", "age_validation", "deduplication", "text_standardization"),
    "products": ("price_validation", "cost_validation", "profit_calculation", "categorization"),
    "orders": ("null_validation", "status_validation", "date_enrichment", "categorization"),
    "order_items": ("quantity_validation", "price_validation", "total_correction", "discount_calculation"),
}


# Ingestion digest: stays in bronze, so that it does not widen the deduplication shuffle.
BRONZE_ONLY = ("record_md5",)
NOW = "current_timestamp()"


def _one_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    return first_per_key(df.drop(*BRONZE_ONLY), [key], order_by)


def _with_metadata(df: DataFrame, table: str, processed_at: str) -> DataFrame:
    return add(
        df,
        {
            "silver_processed_timestamp": f"CAST({processed_at} AS TIMESTAMP)",
            "silver_processed_date": f"CAST({processed_at} AS DATE)",
            "data_quality_score": str(QUALITY_SCORES[table]),
            "cleaning_rules_applied": array_of(CLEANING_RULES[table]),
        },
    )


def clean_customers(
    bronze: DataFrame, as_of: date, order_by: Sequence[str] = (), processed_at: str = NOW
) -> DataFrame:
    kept = bronze.filter("email IS NOT NULL AND age BETWEEN 18 AND 100 AND customer_id IS NOT NULL")
    enriched = add(
        _one_per_key(kept, "customer_id", order_by),
        {
            "full_name": "concat(first_name, ' ', last_name)",
            "email_domain": "regexp_extract(email, '@(.+)', 1)",
            "customer_age_group": segments.below("age", AGE_GROUPS, "55+"),
            "registration_year": "year(registration_date)",
            "days_since_registration": calendar.days_until(as_of, "registration_date"),
            "customer_lifetime_category": segments.below("days_since_registration", LIFETIME, "Loyal"),
        },
    )
    standardized = replace(
        enriched,
        {
            **{c: title(c) for c in ("first_name", "last_name", "city")},
            "country": "trim(country)",
            "email": "lower(trim(email))",
        },
    )
    return _with_metadata(standardized, "customers", processed_at)


def clean_products(bronze: DataFrame, order_by: Sequence[str] = (), processed_at: str = NOW) -> DataFrame:
    kept = bronze.filter("price > 0 AND cost > 0 AND product_id IS NOT NULL AND price >= cost")
    sides = "split(dimensions, 'x')"
    enriched = add(
        _one_per_key(kept, "product_id", order_by),
        {
            "profit_margin_pct": "round((price - cost) / price * 100, 2)",
            "profit_amount": "round(price - cost, 2)",
            "price_category": segments.below("price", PRICE_CLASSES, "Luxury"),
            "weight_category": segments.below("weight_kg", WEIGHT_CLASSES, "Very Heavy"),
            "availability_status": f"CASE WHEN in_stock AND stock_quantity > {PLENTY_IN_STOCK} THEN 'Available'"
            " WHEN in_stock AND stock_quantity > 0 THEN 'Low Stock' ELSE 'Out of Stock' END",
            "length_cm": dimension(sides, 0),
            "width_cm": dimension(sides, 1),
            "height_cm": dimension(sides, 2),
            "volume_cm3": "length_cm * width_cm * height_cm",
        },
    )
    names = ("product_name", "category", "sub_category", "brand", "supplier")
    return _with_metadata(replace(enriched, {c: title(c) for c in names}), "products", processed_at)


def clean_orders(
    bronze: DataFrame,
    as_of: date,
    thresholds: Thresholds = Thresholds(),
    order_by: Sequence[str] = (),
    processed_at: str = NOW,
) -> DataFrame:
    # Statuses are compared as they came: another spelling is dropped, not repaired.
    kept = bronze.filter(
        "order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL"
        f" AND status IN ({', '.join(map(text, STATUSES))}) AND order_total >= 0"
    )
    enriched = add(
        _one_per_key(kept, "order_id", order_by),
        {
            "order_year": "year(order_date)",
            "order_month": "month(order_date)",
            "order_quarter": "quarter(order_date)",
            "order_day_of_week": "dayofweek(order_date)",
            "order_day_name": calendar.day_name("order_day_of_week"),
            "is_weekend": f"order_day_of_week IN {WEEKEND}",
            "order_value_category": segments.below("order_total", zip(thresholds.order_value, ORDER_VALUES), "XLarge"),
            "total_order_amount": "order_total + tax_amount + shipping_cost",
            "days_since_order": calendar.days_until(as_of, "order_date"),
            "is_recent_order": f"days_since_order <= {RECENT_DAYS}",
            "season": calendar.season("order_month"),
            "is_holiday_season": f"order_month IN {HOLIDAY_MONTHS}",
        },
    )
    standardized = replace(
        enriched,
        {
            "status": "lower(trim(status))",
            "payment_method": title("payment_method"),
            "shipping_method": title("shipping_method"),
        },
    )
    return _with_metadata(standardized, "orders", processed_at)


def clean_order_items(
    bronze: DataFrame,
    thresholds: Thresholds = Thresholds(),
    order_by: Sequence[str] = (),
    processed_at: str = NOW,
) -> DataFrame:
    kept = bronze.filter(
        "order_item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL"
        " AND quantity > 0 AND unit_price > 0 AND line_total >= 0"
    )
    computed = "quantity * unit_price"
    (single, single_label), *more = QUANTITIES
    enriched = add(
        _one_per_key(kept, "order_item_id", order_by),
        {
            "line_total_corrected": f"IF(abs(line_total - {computed}) > {TOTAL_TOLERANCE}D, {computed}, line_total)",
            "discount_rate": "IF(line_total > 0, round(discount_amount / line_total * 100, 2), 0.0D)",
            "final_amount": "line_total - discount_amount",
            "quantity_category": f"IF(quantity = {single}, {text(single_label)}, {segments.up_to('quantity', more, 'Bulk')})",
            "unit_price_category": segments.below("unit_price", zip(thresholds.unit_price, UNIT_PRICES), "Luxury"),
            "has_discount": "discount_amount > 0",
            "discount_category": "IF(discount_rate = 0, 'No Discount',"
            f" {segments.below('discount_rate', DISCOUNT_CLASSES, 'Large')})",
        },
    )
    return _with_metadata(enriched, "order_items", processed_at)
