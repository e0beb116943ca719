"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the operator definitions, not generated from the plans: the raw tables are rebuilt from
the test tables in SQL, and every layer is a common table expression on top of the one before.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-02'"


def _money(x: str) -> str:
    """Exact sum of money as a double."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(24,6))) AS DOUBLE)"


def _money_avg(x: str) -> str:
    return f"{_money(x)} / NULLIF(COUNT({x}), 0)"


def _round(x: str, digits: int = 2) -> str:
    """Half away from zero on the shortest decimal form of a double."""
    return f"CAST(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,{digits})) AS DOUBLE)"


def _six(x: str) -> str:
    return f"FLOOR(({x}) * 1e6 + 0.5) / 1e6"


def _title(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower(trim({x})), ' '),"
        " lambda w: upper(w[1]) || w[2:]), ' ')"
    )


def _count(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def _months_between(d: str, f: str) -> str:
    whole = f"((year({d}) - year({f})) * 12 + month({d}) - month({f}))"
    return (
        f"CASE WHEN day({d}) = day({f}) OR ({d} = last_day({d}) AND {f} = last_day({f})) THEN CAST({whole} AS DOUBLE)"
        f" ELSE round({whole} + (day({d}) - day({f})) / CAST(31 AS DOUBLE), 8) END"
    )


# Common table expressions, each after those it uses.
CTES: dict[str, str] = {}

CTES["raw_customers"] = """
SELECT CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE c_custkey END AS customer_id,
       CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN ' ANNA' WHEN 1 THEN 'ben ' ELSE 'Chris' END AS first_name,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'van DYK' WHEN 1 THEN ' roe ' WHEN 2 THEN 'STONE' ELSE 'Hill' END
           AS last_name,
       CASE WHEN c_custkey % 41 = 3 THEN NULL WHEN c_custkey % 53 = 9 THEN 'bad-email'
            ELSE ' User' || CAST(c_custkey AS STRING) || '@Mail' || CAST(c_custkey % 5 AS STRING) || '.com' END AS email,
       DATE '1993-01-01' + CAST((c_custkey * 37) % 3130 AS INT) AS registration_date,
       ' ' || n_name AS country,
       ' old TOWN ' || CAST(c_custkey % 30 AS STRING) AS city,
       CAST(15 + c_custkey % 90 AS INT) AS age,
       c_mktsegment AS customer_segment,
       seq AS ingest_seq
FROM customer JOIN nation ON c_nationkey = n_nationkey
     JOIN (SELECT 0 AS seq UNION ALL SELECT 1 AS seq) dup ON seq = 0 OR c_custkey % 50 = 7
"""
CTES["raw_products"] = """
SELECT product_id, product_name, category, sub_category, brand, price,
       FLOOR(price * CAST(4 + k % 8 AS DOUBLE) * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS cost,
       weight_kg, dimensions, in_stock, stock_quantity, supplier, ingest_seq
FROM (
  SELECT p_partkey AS k,
         CASE WHEN p_partkey % 89 = 4 THEN NULL ELSE p_partkey END AS product_id,
         ' ' || UPPER(p_name) AS product_name, p_type AS category, p_name AS sub_category, p_brand AS brand,
         CASE WHEN p_partkey % 61 = 8 THEN CAST(0 AS DOUBLE)
              ELSE FLOOR(p_retailprice * CAST(1 + p_partkey % 20 AS DOUBLE) * CAST(5 AS DOUBLE) + CAST(0.5 AS DOUBLE))
                   / CAST(100 AS DOUBLE) END AS price,
         CAST(p_size AS DOUBLE) / CAST(2 AS DOUBLE) AS weight_kg,
         CASE WHEN p_partkey % 71 = 2 THEN '10x20' WHEN p_partkey % 71 = 3 THEN 'n/a' WHEN p_partkey % 71 = 4 THEN NULL
              ELSE CAST(5 + p_size % 46 AS STRING) || 'x' || CAST(5 + p_partkey % 46 AS STRING) || 'x'
                   || CAST(2 + p_partkey % 29 AS STRING) || ' cm' END AS dimensions,
         p_partkey % 5 <> 0 AS in_stock,
         CAST(p_partkey % 37 AS INT) AS stock_quantity,
         'supplier ' || CAST(p_partkey % 12 AS STRING) AS supplier,
         seq AS ingest_seq
  FROM part JOIN (SELECT 0 AS seq UNION ALL SELECT 1 AS seq) dup ON seq = 0 OR p_partkey % 50 = 7
) p
"""
CTES["raw_orders"] = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_orderkey % 211 = 6 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN o_orderkey % 223 = 8 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
       CASE WHEN o_orderkey % 101 = 1 THEN 'returned' WHEN o_orderkey % 103 = 2 THEN 'Completed'
            WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'cancelled' END AS status,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN ' CREDIT card' WHEN 1 THEN 'debit card' WHEN 2 THEN 'paypal'
            ELSE 'Bank Transfer ' END AS payment_method,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'standard' WHEN 1 THEN 'EXPRESS' ELSE 'Overnight' END AS shipping_method,
       CASE WHEN o_orderkey % 307 = 9 THEN -o_totalprice ELSE o_totalprice END AS order_total,
       FLOOR(o_totalprice * CAST(8 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS tax_amount,
       CASE WHEN o_orderstatus = 'F' THEN CAST(5 + o_orderkey % 21 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS shipping_cost,
       seq AS ingest_seq
FROM orders JOIN (SELECT 0 AS seq UNION ALL SELECT 1 AS seq) dup ON seq = 0 OR o_orderkey % 50 = 7
"""
CTES["raw_order_items"] = """
SELECT l_orderkey * 10 + l_linenumber AS order_item_id,
       l_orderkey AS order_id,
       l_partkey AS product_id,
       CASE WHEN l_partkey % 401 = 7 THEN 0 ELSE CAST(l_quantity AS INT) END AS quantity,
       FLOOR(l_extendedprice / l_quantity * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS unit_price,
       CASE WHEN l_partkey % 30 = 1 THEN l_extendedprice + CAST(5 AS DOUBLE) ELSE l_extendedprice END AS line_total,
       CASE WHEN l_partkey % 45 = 2 THEN NULL WHEN l_partkey % 47 = 3 THEN -l_extendedprice
            WHEN l_partkey % 43 = 4 THEN FLOOR(l_extendedprice * CAST(20 AS DOUBLE)) / CAST(100 AS DOUBLE)
            ELSE FLOOR(l_extendedprice * l_discount * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) END
           AS discount_amount,
       l_suppkey AS supplier_id
FROM lineitem
"""
CTES["silver_customers"] = f"""
SELECT customer_id, {_title('first_name')} AS first_name, {_title('last_name')} AS last_name,
       lower(trim(email)) AS email, registration_date, trim(country) AS country, {_title('city')} AS city, age,
       customer_segment, ingest_seq,
       first_name || ' ' || last_name AS full_name,
       regexp_extract(email, '@(.+)', 1) AS email_domain,
       CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54'
            ELSE '55+' END AS customer_age_group,
       CAST(year(registration_date) AS INTEGER) AS registration_year,
       CAST({AS_OF} - registration_date AS INTEGER) AS days_since_registration,
       CASE WHEN {AS_OF} - registration_date < 30 THEN 'New' WHEN {AS_OF} - registration_date < 365 THEN 'Active'
            ELSE 'Loyal' END AS customer_lifetime_category,
       95 AS data_quality_score,
       'null_removal,age_validation,deduplication,text_standardization' AS cleaning_rules_applied
FROM raw_customers
WHERE email IS NOT NULL AND age BETWEEN 18 AND 100 AND customer_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ingest_seq) = 1
"""
_SIDE = "TRY_CAST(regexp_extract(string_split(dimensions, 'x')[{0}], '(\\d+)', 1) AS DOUBLE)"
CTES["silver_products"] = f"""
SELECT product_id, {_title('product_name')} AS product_name, {_title('category')} AS category,
       {_title('sub_category')} AS sub_category, {_title('brand')} AS brand, price, cost, weight_kg, dimensions, in_stock,
       stock_quantity, {_title('supplier')} AS supplier, ingest_seq,
       {_round('(price - cost) / price * 100')} AS profit_margin_pct,
       {_round('price - cost')} AS profit_amount,
       CASE WHEN price < 50 THEN 'Budget' WHEN price < 200 THEN 'Mid-Range' WHEN price < 500 THEN 'Premium' ELSE 'Luxury' END
           AS price_category,
       CASE WHEN weight_kg < 1 THEN 'Light' WHEN weight_kg < 5 THEN 'Medium' WHEN weight_kg < 20 THEN 'Heavy'
            ELSE 'Very Heavy' END AS weight_category,
       CASE WHEN in_stock AND stock_quantity > 10 THEN 'Available' WHEN in_stock AND stock_quantity > 0 THEN 'Low Stock'
            ELSE 'Out of Stock' END AS availability_status,
       {_SIDE.format(1)} AS length_cm, {_SIDE.format(2)} AS width_cm, {_SIDE.format(3)} AS height_cm,
       {_SIDE.format(1)} * {_SIDE.format(2)} * {_SIDE.format(3)} AS volume_cm3,
       92 AS data_quality_score,
       'price_validation,cost_validation,profit_calculation,categorization' AS cleaning_rules_applied
FROM raw_products
WHERE price > 0 AND cost > 0 AND product_id IS NOT NULL AND price >= cost
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ingest_seq) = 1
"""
CTES["silver_orders"] = f"""
SELECT order_id, customer_id, order_date, lower(trim(status)) AS status, {_title('payment_method')} AS payment_method,
       {_title('shipping_method')} AS shipping_method, order_total, tax_amount, shipping_cost, ingest_seq,
       CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month,
       CAST(quarter(order_date) AS INTEGER) AS order_quarter,
       CAST(dayofweek(order_date) + 1 AS INTEGER) AS order_day_of_week,
       dayname(order_date) AS order_day_name,
       dayofweek(order_date) IN (0, 6) AS is_weekend,
       CASE WHEN order_total < 50000 THEN 'Small' WHEN order_total < 150000 THEN 'Medium'
            WHEN order_total < 300000 THEN 'Large' ELSE 'XLarge' END AS order_value_category,
       order_total + tax_amount + shipping_cost AS total_order_amount,
       CAST({AS_OF} - order_date AS INTEGER) AS days_since_order,
       {AS_OF} - order_date <= 30 AS is_recent_order,
       CASE WHEN month(order_date) IN (12, 1, 2) THEN 'Winter' WHEN month(order_date) IN (3, 4, 5) THEN 'Spring'
            WHEN month(order_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
       month(order_date) IN (11, 12) AS is_holiday_season,
       90 AS data_quality_score,
       'null_validation,status_validation,date_enrichment,categorization' AS cleaning_rules_applied
FROM raw_orders
WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL
  AND status IN ('completed', 'pending', 'cancelled') AND order_total >= 0
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ingest_seq) = 1
"""
CTES["silver_order_items"] = f"""
SELECT *,
       CASE WHEN discount_rate = 0 THEN 'No Discount' WHEN discount_rate < 5 THEN 'Small' WHEN discount_rate < 15 THEN 'Medium'
            ELSE 'Large' END AS discount_category
FROM (
  SELECT *,
         CASE WHEN abs(line_total - quantity * unit_price) > CAST(0.01 AS DOUBLE) THEN quantity * unit_price
              ELSE line_total END AS line_total_corrected,
         CASE WHEN line_total > 0 THEN {_round('discount_amount / line_total * 100')} ELSE 0.0::DOUBLE END AS discount_rate,
         line_total - discount_amount AS final_amount,
         CASE WHEN quantity = 1 THEN 'Single' WHEN quantity <= 3 THEN 'Few' WHEN quantity <= 5 THEN 'Multiple' ELSE 'Bulk' END
             AS quantity_category,
         CASE WHEN unit_price < 500 THEN 'Budget' WHEN unit_price < 2000 THEN 'Standard' WHEN unit_price < 5000 THEN 'Premium'
              ELSE 'Luxury' END AS unit_price_category,
         discount_amount > 0 AS has_discount,
         88 AS data_quality_score,
         'quantity_validation,price_validation,total_correction,discount_calculation' AS cleaning_rules_applied
  FROM raw_order_items
  WHERE order_item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL
    AND quantity > 0 AND unit_price > 0 AND line_total >= 0
  QUALIFY row_number() OVER (PARTITION BY order_item_id ORDER BY product_id, supplier_id) = 1
)
"""
CTES["done"] = "SELECT * FROM silver_orders WHERE status = 'completed'"
CTES["sold"] = """
SELECT i.*, o.customer_id, o.order_date, o.order_total FROM silver_order_items i JOIN done o ON i.order_id = o.order_id
"""
CTES["sold_with_category"] = "SELECT s.*, p.category FROM sold s JOIN silver_products p ON s.product_id = p.product_id"
CTES["order_metrics"] = f"""
SELECT customer_id, COUNT(order_id) AS total_orders, {_money('order_total')} AS total_spent,
       {_money_avg('order_total')} AS avg_order_value, MAX(order_date) AS last_order_date, MIN(order_date) AS first_order_date,
       {_money('tax_amount')} AS total_tax_paid, {_money('shipping_cost')} AS total_shipping_paid,
       COUNT(DISTINCT order_year) AS active_years, COUNT(DISTINCT order_month) AS active_months
FROM done GROUP BY customer_id
"""
CTES["favorite"] = """
SELECT customer_id, category AS favorite_category
FROM (SELECT customer_id, category, COUNT(*) AS n FROM sold_with_category GROUP BY customer_id, category)
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category ASC NULLS FIRST) = 1
"""
CTES["product_metrics"] = f"""
SELECT m.*, favorite_category
FROM (SELECT customer_id, COUNT(DISTINCT product_id) AS unique_products_bought,
             COUNT(DISTINCT category) AS categories_shopped, {_count('quantity')} AS total_items_bought
      FROM sold_with_category GROUP BY customer_id) m
JOIN favorite f ON m.customer_id = f.customer_id
"""
CTES["customer_analytics"] = f"""
SELECT c.customer_id, full_name, email, country, city, customer_age_group, customer_segment, registration_date,
       days_since_registration, customer_lifetime_category,
       coalesce(total_orders, 0) AS total_orders, coalesce(total_spent, 0.0) AS total_spent,
       coalesce(avg_order_value, 0.0) AS avg_order_value, last_order_date, first_order_date,
       coalesce(total_tax_paid, 0.0) AS total_tax_paid, coalesce(total_shipping_paid, 0.0) AS total_shipping_paid,
       coalesce(active_years, 0) AS active_years, coalesce(active_months, 0) AS active_months,
       coalesce(unique_products_bought, 0) AS unique_products_bought, coalesce(categories_shopped, 0) AS categories_shopped,
       coalesce(total_items_bought, 0) AS total_items_bought, favorite_category,
       CAST({AS_OF} - last_order_date AS INTEGER) AS days_since_last_order,
       CAST(coalesce(last_order_date - first_order_date, 0) AS INTEGER) AS customer_lifespan_days,
       CASE WHEN total_orders > 0 THEN total_spent / total_orders ELSE 0.0 END AS calculated_aov,
       CASE WHEN total_spent >= 1000000 THEN 'High Value' WHEN total_spent >= 500000 THEN 'Medium Value'
            WHEN total_spent >= 100000 THEN 'Low Value' WHEN total_spent > 0 THEN 'Minimal Value'
            ELSE 'No Purchase' END AS value_segment,
       CASE WHEN last_order_date IS NULL THEN 'Never Purchased' WHEN {AS_OF} - last_order_date <= 30 THEN 'Recent'
            WHEN {AS_OF} - last_order_date <= 90 THEN 'Active' WHEN {AS_OF} - last_order_date <= 365 THEN 'At Risk'
            ELSE 'Churned' END AS recency_segment,
       CASE WHEN total_orders >= 10 THEN 'Frequent' WHEN total_orders >= 5 THEN 'Regular'
            WHEN total_orders >= 2 THEN 'Occasional' WHEN total_orders = 1 THEN 'One-time'
            ELSE 'No Purchase' END AS frequency_segment
FROM silver_customers c LEFT JOIN order_metrics o ON c.customer_id = o.customer_id
     LEFT JOIN product_metrics p ON c.customer_id = p.customer_id
"""
CTES["product_sales"] = f"""
SELECT product_id, {_count('quantity')} AS total_quantity_sold, {_money('line_total_corrected')} AS total_revenue,
       {_money('discount_amount')} AS total_discounts_given, COUNT(order_id) AS total_order_appearances,
       COUNT(DISTINCT order_id) AS unique_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       {_money_avg('unit_price')} AS avg_selling_price, MAX(order_date) AS last_sold_date, MIN(order_date) AS first_sold_date
FROM sold GROUP BY product_id
"""
CTES["product_figures"] = f"""
SELECT p.product_id, product_name, category, sub_category, brand, price, cost, profit_margin_pct, profit_amount,
       price_category, weight_category, availability_status, stock_quantity, in_stock,
       coalesce(total_quantity_sold, 0) AS total_quantity_sold, coalesce(total_revenue, 0.0) AS total_revenue,
       coalesce(total_discounts_given, 0.0) AS total_discounts_given,
       coalesce(total_order_appearances, 0) AS total_order_appearances, coalesce(unique_orders, 0) AS unique_orders,
       coalesce(unique_customers, 0) AS unique_customers, coalesce(avg_selling_price, 0.0) AS avg_selling_price,
       last_sold_date, first_sold_date,
       CASE WHEN total_quantity_sold > 0 THEN total_revenue / total_quantity_sold ELSE 0.0 END AS revenue_per_unit,
       CASE WHEN total_quantity_sold > 0 THEN total_revenue - cost * total_quantity_sold ELSE 0.0 END AS total_profit,
       CASE WHEN unique_orders > 0 THEN total_quantity_sold / unique_orders ELSE 0.0 END AS avg_quantity_per_order,
       CASE WHEN total_quantity_sold >= 300 THEN 'Top Seller' WHEN total_quantity_sold >= 200 THEN 'Good Seller'
            WHEN total_quantity_sold >= 100 THEN 'Average Seller' WHEN total_quantity_sold > 0 THEN 'Slow Seller'
            ELSE 'No Sales' END AS sales_performance,
       CASE WHEN unique_customers >= 15 THEN 'High Demand' WHEN unique_customers >= 10 THEN 'Medium Demand'
            WHEN unique_customers >= 5 THEN 'Low Demand' WHEN unique_customers > 0 THEN 'Very Low Demand'
            ELSE 'No Demand' END AS demand_level,
       CAST({AS_OF} - last_sold_date AS INTEGER) AS days_since_last_sale
FROM silver_products p LEFT JOIN product_sales s ON p.product_id = s.product_id
"""
CTES["monthly_sales"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC, order_year, order_month) AS INTEGER) AS revenue_rank,
       monthname(make_date(order_year, order_month, 1)) AS month_name,
       CAST(order_year AS VARCHAR) || '-' || lpad(CAST(order_month AS VARCHAR), 2, '0') AS year_month
FROM (SELECT order_year, order_month, COUNT(order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers,
             {_money('order_total')} AS total_revenue, {_money_avg('order_total')} AS avg_order_value,
             {_money('tax_amount')} AS total_tax, {_money('shipping_cost')} AS total_shipping,
             MIN(order_date) AS month_start_date, MAX(order_date) AS month_end_date
      FROM done GROUP BY order_year, order_month)
"""
CTES["daily_sales"] = f"""
SELECT order_date, order_day_name, is_weekend, COUNT(order_id) AS total_orders,
       COUNT(DISTINCT customer_id) AS unique_customers, {_money('order_total')} AS total_revenue,
       {_money_avg('order_total')} AS avg_order_value,
       CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS weekday_performance
FROM done GROUP BY order_date, order_day_name, is_weekend
"""
CTES["category_sales"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC, category) AS INTEGER) AS revenue_rank,
       total_revenue / unique_products AS avg_revenue_per_product
FROM (SELECT category, {_count('quantity')} AS total_quantity_sold, {_money('line_total_corrected')} AS total_revenue,
             COUNT(order_item_id) AS total_items, COUNT(DISTINCT order_id) AS unique_orders,
             COUNT(DISTINCT customer_id) AS unique_customers, COUNT(DISTINCT product_id) AS unique_products,
             {_money_avg('unit_price')} AS avg_selling_price, {_money('discount_amount')} AS total_discounts
      FROM sold_with_category GROUP BY category)
"""
CTES["first_purchase"] = """
SELECT o.customer_id, MIN(o.order_date) AS fp, strftime(MIN(o.order_date), '%Y-%m') AS cohort_month
FROM done o JOIN silver_customers c ON o.customer_id = c.customer_id GROUP BY o.customer_id
"""
CTES["cohort_activity"] = f"""
SELECT o.customer_id, o.order_id, o.order_total, f.cohort_month, {_months_between('o.order_date', 'f.fp')} AS months
FROM done o JOIN first_purchase f ON o.customer_id = f.customer_id
"""
CTES["cohort_size_by_month"] = """
SELECT cohort_month, COUNT(DISTINCT customer_id) AS cohort_size FROM first_purchase GROUP BY cohort_month
"""


def _cohorts(age: str) -> str:
    return f"""
SELECT a.cohort_month, months_since_first_purchase, cohort_size, active_customers,
       {_round('active_customers / cohort_size * 100')} AS retention_rate, cohort_revenue,
       {_round('cohort_revenue / active_customers')} AS revenue_per_customer, cohort_orders
FROM (SELECT cohort_month, {age} AS months_since_first_purchase, COUNT(DISTINCT customer_id) AS active_customers,
             {_money('order_total')} AS cohort_revenue, COUNT(order_id) AS cohort_orders
      FROM cohort_activity GROUP BY cohort_month, {age}) a
JOIN cohort_size_by_month s ON a.cohort_month = s.cohort_month
"""


CTES["cohort_analysis"] = _cohorts("months")
CTES["cohort_by_month"] = _cohorts("CAST(floor(months) AS INTEGER)")
CTES["month_numbers"] = """
SELECT *, order_year * 12 + order_month AS month_numeric FROM monthly_sales
"""
CTES["split_months"] = """
SELECT *, month_numeric < (SELECT MIN(month_numeric) + ceil((MAX(month_numeric) - MIN(month_numeric) + 1) * 0.8::DOUBLE)
                           FROM month_numbers) AS is_train
FROM month_numbers
"""
CTES["fitted_line"] = """
SELECT regr_slope(total_orders, month_numeric) AS slope, regr_intercept(total_orders, month_numeric) AS intercept,
       CAST(regr_count(total_orders, month_numeric) AS BIGINT) AS months
FROM split_months WHERE is_train
"""
CTES["predictions"] = """
SELECT order_year, order_month, total_orders, slope * month_numeric + intercept AS prediction,
       total_orders - (slope * month_numeric + intercept) AS residual
FROM split_months, fitted_line WHERE NOT is_train
"""

CTES["category_months"] = """
SELECT category, CAST(year(o.order_date) AS INTEGER) AS order_year, CAST(month(o.order_date) AS INTEGER) AS order_month,
       COUNT(DISTINCT o.order_id) AS total_orders, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold
FROM silver_order_items i JOIN done o ON i.order_id = o.order_id JOIN silver_products p ON i.product_id = p.product_id
GROUP BY 1, 2, 3
"""
CTES["split_category_months"] = """
SELECT *, month_numeric < low + ceil((high - low + 1) * 0.8::DOUBLE) AS is_train
FROM (SELECT *, MIN(month_numeric) OVER w AS low, MAX(month_numeric) OVER w AS high
      FROM (SELECT *, order_year * 12 + order_month AS month_numeric FROM category_months) WINDOW w AS (PARTITION BY category))
"""
CTES["category_lines"] = """
SELECT category, regr_slope(total_orders, month_numeric) AS slope, regr_intercept(total_orders, month_numeric) AS intercept,
       CAST(regr_count(total_orders, month_numeric) AS BIGINT) AS months
FROM split_category_months WHERE is_train GROUP BY category
"""

RULES = {
    "customers": (
        ("no_null_customer_id", "customer_id IS NOT NULL"),
        ("valid_email_format", "regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$')"),
        ("valid_age_range", "age BETWEEN 18 AND 100"),
        ("no_duplicate_customers", None),
    ),
    "products": (
        ("no_null_product_id", "product_id IS NOT NULL"),
        ("positive_price", "price > 0"),
        ("positive_cost", "cost > 0"),
        ("valid_profit_margin", "profit_margin_pct >= 0"),
        ("price_greater_than_cost", "price >= cost"),
    ),
    "orders": (
        ("no_null_order_id", "order_id IS NOT NULL"),
        ("no_null_customer_id", "customer_id IS NOT NULL"),
        ("valid_status", "status IN ('completed', 'pending', 'cancelled')"),
        ("non_negative_total", "order_total >= 0"),
        ("valid_order_date", "order_date IS NOT NULL"),
    ),
    "order_items": (
        ("no_null_item_id", "order_item_id IS NOT NULL"),
        ("positive_quantity", "quantity > 0"),
        ("positive_unit_price", "unit_price > 0"),
        ("non_negative_total", "line_total_corrected >= 0"),
        ("valid_discount", "discount_amount >= 0"),
    ),
}
SILVER_ONLY = ("profit_margin_pct", "line_total_corrected")


def _rule_rows(layer: str, rules: dict) -> str:
    rows = []
    for table, checks in rules.items():
        for name, predicate in checks:
            if layer == "raw" and predicate and any(c in predicate for c in SILVER_ONLY):
                rows.append(
                    f"SELECT '{table}' AS table_name, '{name} (error)' AS rule_name, CAST(NULL AS BIGINT) AS failed_count,"
                    " false AS passed"
                )
                continue
            failed = (
                f"COUNT(*) FILTER (WHERE NOT ({predicate}))"
                if predicate
                else "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT customer_id FROM "
                f"{layer}_{table}))"
            )
            rows.append(
                f"SELECT '{table}' AS table_name, '{name}' AS rule_name, {failed} AS failed_count, {failed} = 0 AS passed"
                f" FROM {layer}_{table}"
            )
    return "\nUNION ALL\n".join(rows)


CTES["silver_rules"] = _rule_rows("silver", RULES)
CTES["quality_scores"] = f"""
SELECT table_name, COUNT(*) AS rules_total, COUNT(*) FILTER (WHERE passed) AS rules_passed,
       {_round('COUNT(*) FILTER (WHERE passed) / COUNT(*) * 100', 1)} AS quality_score
FROM silver_rules GROUP BY table_name
"""


def _check(name: str, count_sql: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(n AS BIGINT) AS failed_count, n = 0 AS passed FROM ({count_sql})"


ORPHANS = {
    "orders_with_invalid_customers": ("silver_orders", "silver_customers", "customer_id"),
    "items_with_invalid_orders": ("silver_order_items", "silver_orders", "order_id"),
    "items_with_invalid_products": ("silver_order_items", "silver_products", "product_id"),
}


def _orphans(name: str) -> str:
    child, parent, key = ORPHANS[name]
    return _check(
        name, f"SELECT COUNT(*) AS n FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
    )


MISMATCHES = _check(
    "order_total_mismatches",
    f"""SELECT COUNT(*) AS n FROM silver_orders o
        JOIN (SELECT order_id, {_money('line_total_corrected')} AS line_sum FROM silver_order_items GROUP BY order_id) i
          ON o.order_id = i.order_id
        WHERE abs(order_total - line_sum) > CAST(0.01 AS DOUBLE)""",
)
CTES["cross_checks"] = "\nUNION ALL\n".join([*[_orphans(n) for n in ORPHANS], MISMATCHES])


def _repeats(name: str, table: str, key: str) -> str:
    return _check(name, f"SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM {table})) AS n FROM {table}")


CUSTOMER_COLUMNS = (
    "customer_id", "first_name", "last_name", "email", "registration_date", "country", "city", "age", "customer_segment",
    "ingest_seq",
)
RAW_COLUMNS = {
    "customers": CUSTOMER_COLUMNS,
    "products": (
        "product_id", "product_name", "category", "sub_category", "brand", "price", "cost", "weight_kg", "dimensions",
        "in_stock", "stock_quantity", "supplier", "ingest_seq",
    ),
    "orders": (
        "order_id", "customer_id", "order_date", "status", "payment_method", "shipping_method", "order_total",
        "tax_amount", "shipping_cost", "ingest_seq",
    ),
    "order_items": (
        "order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total", "discount_amount", "supplier_id",
    ),
}
DIGEST_COLUMNS = {
    "customers": CUSTOMER_COLUMNS,
    "products": ("product_id", "product_name", "category", "sub_category", "brand", "dimensions", "stock_quantity", "supplier"),
    "orders": ("order_id", "customer_id", "order_date", "status", "payment_method", "shipping_method", "ingest_seq"),
    "order_items": ("order_item_id", "order_id", "product_id", "quantity", "supplier_id"),
}
BRONZE_EXTRA = (
    "bronze_ingestion_timestamp", "bronze_ingestion_date", "source_system", "source_table", "data_quality_status",
    "record_hash", "record_md5", "bronze_record_id",
)
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id"}


def _bronze(table: str) -> str:
    marked = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '∅')" for c in DIGEST_COLUMNS[table])
    return (
        f"SELECT *, 'data_generation' AS source_system, '{table}' AS source_table, 'raw' AS data_quality_status,"
        f" md5(concat_ws('|', {marked})) AS record_md5 FROM raw_{table}"
    )


def _let(x: str, body: str) -> str:
    """``body`` with v standing for the value of ``x``."""
    return f"list_transform([{x}], lambda v: {body})[1]"


def _murmur3(text: str) -> str:
    """Signed 32-bit Murmur3 (seed 42) of an ASCII text: blocks of four bytes, then each byte of the tail as a block."""

    def u(n: int) -> str:
        return f"CAST({n} AS UBIGINT)"

    mask = u(0xFFFFFFFF)

    def times(x: str, n: int) -> str:
        return f"(({x}) * {u(n)} & {mask})"

    def rotate(x: str, r: int) -> str:
        return _let(x, f"((v << {r}) | (v >> {32 - r})) & {mask}")

    def spread(x: str, r: int) -> str:
        return _let(x, f"xor(v, v >> {r})")

    parts = (
        f"list_transform([list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(({text})[i]) AS UBIGINT))], lambda b: list_concat("
        f"list_transform(range(0, len(b) // 4), lambda k: b[4 * k + 1] + b[4 * k + 2] * {u(1 << 8)} + b[4 * k + 3] * {u(1 << 16)} + b[4 * k + 4] * {u(1 << 24)}),"
        f" b[len(b) - len(b) % 4 + 1:len(b)]))[1]"
    )
    mixed = rotate(f"xor(h, {times(rotate(times('k', 0xCC9E2D51), 15), 0x1B873593)})", 13)
    blocks = f"list_reduce(list_prepend({u(42)}, {parts}), lambda h, k: ({times(mixed, 5)} + {u(0xE6546B64)}) & {mask})"
    ended = spread(f"xor({blocks}, CAST(length({text}) AS UBIGINT))", 16)
    ended = spread(times(spread(times(ended, 0x85EBCA6B), 13), 0xC2B2AE35), 16)
    return _let(ended, f"CAST(CASE WHEN v >= {u(1 << 31)} THEN CAST(v AS BIGINT) - {1 << 32} ELSE CAST(v AS BIGINT) END AS INTEGER)")


def _joined(table: str) -> str:
    return f"concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in DIGEST_COLUMNS[table])})"


def _gold_nulls(table: str, source: str, columns: tuple[str, ...]) -> str:
    issues = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    return f"""
SELECT '{table}' AS table_name, total_records, null_issues, {_round('score', 1)} AS quality_score,
       CASE WHEN score >= 90 THEN 'PASS' WHEN score >= 70 THEN 'WARNING' ELSE 'FAIL' END AS status
FROM (SELECT total_records, null_issues,
             CASE WHEN total_records > 0 THEN greatest(0.0::DOUBLE, 100.0::DOUBLE - null_issues / total_records * 100)
                  ELSE 0.0::DOUBLE END AS score
      FROM (SELECT COUNT(*) AS total_records, {issues} AS null_issues FROM {source}))"""


def _kpi(name: str, kind: str, group: str, number: str, source: str, text: str | None = None) -> str:
    if text is None:
        text = (
            f"CAST(CAST({number} AS BIGINT) AS VARCHAR)"
            if kind == "count"
            else f"regexp_replace(CAST(CAST({number} AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"
        )
    return (
        f"SELECT '{name}' AS metric_name, {text} AS metric_value, '{kind}' AS metric_type, '{group}' AS category,"
        f" CAST({number} AS DOUBLE) AS metric_number FROM {source}"
    )


_ACTIVE = "COUNT(*) FILTER (WHERE recency_segment IN ('Recent', 'Active'))"
_HIGH = "COUNT(*) FILTER (WHERE value_segment = 'High Value')"
_SOLD = "COUNT(*) FILTER (WHERE total_quantity_sold > 0)"
_REVENUE = _money("total_revenue")
_ORDERS = _count("total_orders")

KPI_SQL = "\nUNION ALL\n".join(
    [
        _kpi("Total Customers", "count", "Customer", "COUNT(*)", "customer_analytics"),
        _kpi("Active Customers", "count", "Customer", _ACTIVE, "customer_analytics"),
        _kpi("Customer Activation Rate", "percentage", "Customer", _round(f"{_ACTIVE} / COUNT(*) * 100"), "customer_analytics"),
        _kpi("Total Revenue", "currency", "Revenue", _REVENUE, "monthly_sales"),
        _kpi("Total Orders", "count", "Orders", _ORDERS, "monthly_sales"),
        _kpi("Average Order Value", "currency", "Orders", _round(f"{_REVENUE} / {_ORDERS}"), "monthly_sales"),
        _kpi("Total Products", "count", "Product", "COUNT(*)", "product_figures"),
        _kpi("Products with Sales", "count", "Product", _SOLD, "product_figures"),
        _kpi("Product Sales Rate", "percentage", "Product", _round(f"{_SOLD} / COUNT(*) * 100"), "product_figures"),
        _kpi("High Value Customers", "count", "Customer", _HIGH, "customer_analytics"),
        _kpi(
            "Top Category", "text", "Product", "NULL",
            "(SELECT category AS best FROM category_sales ORDER BY total_revenue DESC, category LIMIT 1)", "best",
        ),
    ]
)


def _metric(name: str, value: str, source: str) -> str:
    return f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}"


EXECUTIVE_SQL = "\nUNION ALL\n".join(
    [
        _metric("total_customers", "COUNT(*)", "customer_analytics"),
        _metric("active_customers", _ACTIVE, "customer_analytics"),
        _metric("active_pct", _round(f"{_ACTIVE} / COUNT(*) * 100", 1), "customer_analytics"),
        _metric("high_value_customers", _HIGH, "customer_analytics"),
        _metric("high_value_pct", _round(f"{_HIGH} / COUNT(*) * 100", 1), "customer_analytics"),
        _metric("total_products", "COUNT(*)", "product_figures"),
        _metric("products_with_sales", _SOLD, "product_figures"),
        _metric("products_with_sales_pct", _round(f"{_SOLD} / COUNT(*) * 100", 1), "product_figures"),
        _metric("total_revenue", _REVENUE, "monthly_sales"),
        _metric("total_orders", _ORDERS, "monthly_sales"),
        _metric("avg_order_value", _round(f"{_REVENUE} / {_ORDERS}"), "monthly_sales"),
    ]
)


def _value_counts(table: str, column: str, name: str = "customer_count") -> str:
    return f"SELECT {column}, COUNT(*) AS {name} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"


_DONE_TOTAL = "CASE WHEN status = 'completed' THEN order_total END"


def _summary(metric: str, number: str, day: str, source: str) -> str:
    return f"SELECT '{metric}' AS metric, CAST({number} AS DOUBLE) AS number, CAST({day} AS DATE) AS day FROM {source}"


SUMMARY_SQL = "\nUNION ALL\n".join(
    [
        _summary("total_revenue", _money(_DONE_TOTAL), "NULL", "raw_orders"),
        _summary("avg_order_value", f"{_money(_DONE_TOTAL)} / COUNT({_DONE_TOTAL})", "NULL", "raw_orders"),
        _summary("completion_rate", "COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*) * 100", "NULL", "raw_orders"),
        _summary("first_order", "NULL", "MIN(order_date)", "raw_orders"),
        _summary("last_order", "NULL", "MAX(order_date)", "raw_orders"),
        _summary("first_registration", "NULL", "MIN(registration_date)", "raw_customers"),
        _summary("last_registration", "NULL", "MAX(registration_date)", "raw_customers"),
    ]
)
_MATRIX = """
SELECT cohort_month, string_agg(months_since_first_purchase || '=' || CAST(retention_rate AS DECIMAL(18,2)), ' '
       ORDER BY months_since_first_purchase) AS rates
FROM cohort_by_month GROUP BY cohort_month"""
_MEAN8 = "CAST(SUM(CAST({0} AS DECIMAL(28,8))) AS DOUBLE) / COUNT({0})"

SELECTS: dict[str, str] = {
    "io01_raw_customers": "SELECT * FROM raw_customers",
    "io01_raw_products": "SELECT * FROM raw_products",
    "io01_raw_orders": "SELECT * FROM raw_orders",
    "io01_raw_order_items": "SELECT * FROM raw_order_items",
    "io01_read_layer": "SELECT * FROM part",
    "io09_clustered_orders": "SELECT * FROM silver_orders",
    "io09_clustered_order_items": "SELECT * FROM silver_order_items",
    "io11_bounded_countries": "SELECT trim(country) AS country, COUNT(*) AS customer_count FROM raw_customers"
    " WHERE country IS NOT NULL GROUP BY 1 ORDER BY customer_count DESC, country LIMIT 5",
    "io12_sql_age_groups": _value_counts("silver_customers", "customer_age_group"),
    "au04_record_totals": "SELECT COUNT(*) AS tables, CAST(SUM(n) AS BIGINT) AS total_records FROM ("
    + " UNION ALL ".join(f"SELECT COUNT(*) AS n FROM silver_{t}" for t in KEYS) + ")",
    "au05_lineage": f"""
SELECT n.table_name, bronze_records, silver_records, silver_records - bronze_records AS record_change,
       {_round('(silver_records - bronze_records) / bronze_records * 100')} AS change_percentage,
       'null_removal,duplicate_removal,data_validation,standardization,enrichment' AS transformation_rules, quality_score
FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM raw_{t}) AS bronze_records,"
        f" (SELECT COUNT(*) FROM silver_{t}) AS silver_records" for t in KEYS
    )
    + ") n JOIN quality_scores q ON n.table_name = q.table_name",
    "br01_bronze_orders_full": f"""
SELECT * EXCLUDE (joined), '2001-08-02 12:30:00' AS bronze_ingestion_timestamp, DATE '2001-08-02' AS bronze_ingestion_date,
       {_murmur3('joined')} AS record_hash, true AS has_record_id
FROM (SELECT *, {_joined('orders')} AS joined FROM ({_bronze('orders')}))""",
    "br04_record_hash": f"SELECT order_id, ingest_seq, {_murmur3('joined')} AS record_hash FROM (SELECT *, {_joined('orders')} AS joined FROM raw_orders)",
    "br05_record_id": "SELECT COUNT(*) AS records, COUNT(*) AS ids, COUNT(*) AS distinct_ids FROM raw_orders",
    "br03_bronze_customers": _bronze("customers"),
    "br03_bronze_products": _bronze("products"),
    "br03_bronze_orders": _bronze("orders"),
    "br03_bronze_order_items": _bronze("order_items"),
    "br06_validation": f"""
SELECT 'orders' AS table_name, COUNT(*) AS record_count, {len(RAW_COLUMNS['orders']) + len(BRONZE_EXTRA)} AS column_count,
       '{",".join([*RAW_COLUMNS['orders'], 'coupon_code'])}' AS expected_columns,
       '{",".join([*RAW_COLUMNS['orders'], *BRONZE_EXTRA])}' AS actual_columns,
       'coupon_code' AS missing_columns, '{",".join(BRONZE_EXTRA)}' AS extra_columns,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT order_id FROM raw_orders)) AS duplicate_count
FROM raw_orders""",
    "br07_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS record_count FROM raw_{t}" for t in KEYS),
    "br09_null_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM raw_{t}"
        for t, columns in RAW_COLUMNS.items() for c in columns
    ),
    "br10_duplicates": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS record_count,"
        f" (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM raw_{t})) AS distinct_count,"
        f" COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM raw_{t})) AS duplicate_count FROM raw_{t}"
        for t, k in KEYS.items()
    ),
    "br11_source_file": "SELECT *, 'products' AS source_file FROM raw_products",
    "sc_silver_customers": "SELECT * FROM silver_customers",
    "sp_silver_products": "SELECT * FROM silver_products",
    "so_silver_orders": "SELECT * FROM silver_orders",
    "si_silver_order_items": "SELECT * FROM silver_order_items",
    "dq01_silver_rules": "SELECT * FROM silver_rules",
    "dq07_raw_rules": _rule_rows("raw", RULES),
    "dq08_quality_scores": "SELECT * FROM quality_scores",
    "dq09_orders_without_customer": _orphans("orders_with_invalid_customers"),
    "dq10_items_without_order": _orphans("items_with_invalid_orders"),
    "dq11_items_without_product": _orphans("items_with_invalid_products"),
    "dq12_total_mismatches": MISMATCHES,
    "dq13_cross_table_checks": "SELECT * FROM cross_checks",
    "dq13_checks_passed": "SELECT COUNT(*) FILTER (WHERE passed) AS checks_passed, COUNT(*) AS checks_total FROM cross_checks",
    "dq14_gold_assessment": "\nUNION ALL\n".join(
        [
            _gold_nulls("customer_analytics", "customer_analytics", ("customer_id", "total_spent", "total_orders")),
            _gold_nulls("product_analytics", "product_figures", ("product_id", "total_revenue", "sales_performance")),
            _gold_nulls("monthly_sales", "monthly_sales", ("order_year", "order_month", "total_revenue")),
            _gold_nulls("daily_sales", "daily_sales", ("order_date", "total_revenue")),
            _gold_nulls("category_sales", "category_sales", ("category", "total_revenue")),
            _gold_nulls("cohort_analysis", "cohort_analysis", ("cohort_month", "retention_rate")),
        ]
    ),
    "dq15_raw_checks": "\nUNION ALL\n".join(
        [
            _repeats("duplicate_customer_ids", "raw_customers", "customer_id"),
            _repeats("duplicate_customer_emails", "raw_customers", "email"),
            _check(
                "null_customer_values",
                "SELECT " + " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in CUSTOMER_COLUMNS)
                + " AS n FROM raw_customers",
            ),
            _repeats("duplicate_product_ids", "raw_products", "product_id"),
            _check("price_not_above_cost", "SELECT COUNT(*) FILTER (WHERE price <= cost) AS n FROM raw_products"),
            _repeats("duplicate_order_ids", "raw_orders", "order_id"),
            _repeats("duplicate_order_item_ids", "raw_order_items", "order_item_id"),
        ]
    ),
    "dq16_required_rules": _rule_rows(
        "silver",
        {"customers": (("email_present", "email IS NOT NULL"), ("age_in_range", "NOT (age < 18 OR age > 100)"), ("customer_id_unique", None))},
    ),
    "dq18_money_scale": "\nUNION ALL\n".join(
        _check(
            f"{table}_{column}_off_scale",
            f"SELECT COUNT(*) FILTER (WHERE abs({column} - round({column}, 6)) > 1e-9::DOUBLE + abs({column}) * 1e-14::DOUBLE) AS n FROM silver_{table}",
        )
        for table, column in (
            ("orders", "order_total"), ("orders", "tax_amount"), ("orders", "shipping_cost"),
            ("order_items", "line_total_corrected"), ("order_items", "discount_amount"), ("order_items", "unit_price"),
        )
    ),
    "dq17_preview_customers": f"SELECT {', '.join(CUSTOMER_COLUMNS)} FROM silver_customers ORDER BY customer_id LIMIT 3",
    "gc01_order_metrics": "SELECT * FROM order_metrics",
    "gc02_product_metrics": "SELECT * FROM product_metrics",
    "gc04_customer_analytics": "SELECT * FROM customer_analytics",
    "gc12_metadata": "SELECT customer_id, '1.0' AS analytics_version FROM customer_analytics",
    "gc13_customer_order_counts": """
SELECT c.customer_id, full_name, country, customer_age_group, COUNT(o.order_id) AS total_orders,
       COUNT(DISTINCT o.order_id) AS unique_orders, MAX(o.order_date) AS last_order_date, MIN(o.order_date) AS first_order_date
FROM silver_customers c LEFT JOIN silver_orders o ON c.customer_id = o.customer_id
GROUP BY c.customer_id, full_name, country, customer_age_group""",
    "gp01_product_sales": "SELECT * FROM product_sales",
    "gp02_product_figures": "SELECT * FROM product_figures",
    "gp09_product_analytics": "SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_id) AS revenue_rank FROM product_figures",
    "gp10_metadata": "SELECT product_id, '2001-08-02 12:30:00' AS gold_created_timestamp, DATE '2001-08-02' AS gold_created_date,"
    " '1.0' AS analytics_version, '2001-08-02 12:30:00' AS last_updated FROM product_figures",
    "gs09_metadata": "SELECT order_date, '2001-08-02 12:30:00' AS gold_created_timestamp, DATE '2001-08-02' AS gold_created_date,"
    " '1.0' AS analytics_version FROM daily_sales",
    "gs01_monthly_sales": "SELECT * FROM monthly_sales",
    "gs01_monthly_counts": "SELECT order_year, order_month, COUNT(order_id) AS total_orders,"
    " COUNT(DISTINCT customer_id) AS unique_customers FROM done GROUP BY order_year, order_month",
    "gs06_daily_sales": "SELECT * FROM daily_sales",
    "gs07_category_sales": "SELECT * FROM category_sales",
    "gh03_cohort_analysis": "SELECT * FROM cohort_analysis",
    "gh04_cohort_sizes": "SELECT * FROM cohort_size_by_month",
    "gh06_cohort_by_month": "SELECT * FROM cohort_by_month",
    "gk01_business_kpis": KPI_SQL,
    "gk01_business_kpis_of_gold": KPI_SQL,
    "gk02_top_customers": "SELECT customer_id, full_name, total_spent, total_orders, value_segment FROM customer_analytics"
    " ORDER BY total_spent DESC, customer_id LIMIT 5",
    "gk03_top_products": "SELECT product_id, product_name, category, total_revenue, total_quantity_sold FROM product_figures"
    " ORDER BY total_revenue DESC, product_id LIMIT 5",
    "gk04_first_months": "SELECT year_month, total_orders, total_revenue, avg_order_value FROM monthly_sales"
    " ORDER BY order_year, order_month LIMIT 10",
    "gk05_category_overview": "SELECT category, total_revenue, unique_customers, avg_selling_price FROM category_sales",
    "gk06_age_groups_sql": _value_counts("customer_analytics", "customer_age_group"),
    "gk07_latest_months_sql": "SELECT order_year, order_month, total_orders FROM monthly_sales"
    " ORDER BY order_year DESC, order_month DESC LIMIT 12",
    "an01_age_groups": _value_counts("customer_analytics", "customer_age_group"),
    "an01_value_segments": _value_counts("customer_analytics", "value_segment"),
    "an01_recency_segments": _value_counts("customer_analytics", "recency_segment"),
    "an01_sales_performance": _value_counts("product_figures", "sales_performance", "product_count"),
    "an02_top_countries": _value_counts("customer_analytics", "country") + " ORDER BY customer_count DESC, country LIMIT 10",
    "an03_country_summary": f"SELECT country, COUNT(customer_id) AS customer_count, {_money('total_spent')} AS total_revenue,"
    f" {_MEAN8.format('avg_order_value')} AS avg_order_value FROM customer_analytics GROUP BY country ORDER BY country LIMIT 15",
    "an04_spending_points": "SELECT customer_id, full_name, country, recency_segment, total_spent, total_orders, value_segment,"
    " days_since_last_order FROM customer_analytics",
    "an05_revenue_by_category": f"SELECT category, {_REVENUE} AS total_revenue FROM product_figures GROUP BY category",
    "an06_product_points": "SELECT product_id, product_name, category, price, total_revenue, total_quantity_sold,"
    " profit_margin_pct, sales_performance FROM product_figures",
    "an07_best_sellers": "SELECT product_id, product_name, total_quantity_sold FROM product_figures"
    " ORDER BY total_quantity_sold DESC, product_id LIMIT 10",
    "an08_category_stats": f"SELECT category, {_REVENUE} AS total_revenue, {_count('total_quantity_sold')} AS total_quantity,"
    f" COUNT(product_id) AS product_count, {_money_avg('profit_margin_pct')} AS avg_profit_margin"
    " FROM product_figures GROUP BY category",
    "an09_monthly_trend": "SELECT year_month, total_revenue, total_orders, avg_order_value, unique_customers FROM monthly_sales",
    "an10_daily_revenue": "SELECT order_date, total_revenue FROM daily_sales",
    "an11_weekday_performance": f"SELECT weekday_performance, {_money_avg('total_revenue')} AS avg_revenue,"
    " SUM(total_orders) / COUNT(*) AS avg_orders, SUM(unique_customers) / COUNT(*) AS avg_customers"
    " FROM daily_sales GROUP BY weekday_performance",
    "an12_retention_matrix": _MATRIX,
    "an12_retention_rates": "SELECT cohort_month, months_since_first_purchase, retention_rate FROM cohort_by_month",
    "an13_cohort_start_sizes": "SELECT cohort_month, cohort_size FROM cohort_by_month WHERE months_since_first_purchase = 0",
    "an14_executive_metrics": EXECUTIVE_SQL,
    "an15_top_category": "SELECT category, total_revenue FROM category_sales ORDER BY total_revenue DESC, category LIMIT 1",
    "an16_order_value_histogram": """
SELECT bin, low + (bin - 1) * (high - low) / 20 AS bin_start, low + bin * (high - low) / 20 AS bin_end,
       COUNT(*) AS customer_count
FROM (SELECT low, high, CAST(least(floor(20 * (avg_order_value - low) / (high - low)) + 1, 20) AS INTEGER) AS bin
      FROM customer_analytics, (SELECT MIN(avg_order_value) AS low, MAX(avg_order_value) AS high FROM customer_analytics))
GROUP BY bin, low, high""",
    "an17_top_age_group": f"SELECT customer_age_group, {_money_avg('total_spent')} AS avg_spent FROM customer_analytics"
    " GROUP BY customer_age_group ORDER BY avg_spent DESC, customer_age_group LIMIT 1",
    "an18_churn_rate": "SELECT COUNT(*) FILTER (WHERE recency_segment = 'Churned') AS churned_customers,"
    " COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE recency_segment = 'Churned') / COUNT(*) * 100 AS churn_rate"
    " FROM customer_analytics",
    "an19_top_country": f"SELECT country, {_money('total_spent')} AS total_revenue FROM customer_analytics GROUP BY country"
    " ORDER BY total_revenue DESC, country LIMIT 1",
    "an20_raw_summary": SUMMARY_SQL,
    "ml01_month_number": "SELECT order_year, order_month, total_orders, month_numeric FROM month_numbers",
    "ml02_features": "SELECT order_year, order_month, total_orders, 1 AS feature_count,"
    " CAST(month_numeric AS DOUBLE) AS month_feature FROM month_numbers",
    "ml04_model_forecast": f"SELECT order_year, order_month, total_orders, {_six('prediction')} AS prediction FROM predictions",
    "ml03_time_split": "SELECT order_year, order_month, is_train FROM split_months",
    "ml04_fitted_line": f"SELECT {_six('slope')} AS slope, {_six('intercept')} AS intercept, months FROM fitted_line",
    "ml05_predictions": f"SELECT order_year, order_month, total_orders, {_six('prediction')} AS prediction,"
    f" {_six('residual')} AS residual FROM predictions",
    "gs07_category_months": "SELECT * FROM category_months",
    "ml04_lines_by_category": f"SELECT category, {_six('slope')} AS slope, {_six('intercept')} AS intercept, months FROM category_lines",
    "ml05_rmse_by_category": f"SELECT s.category, {_six('sqrt(avg(pow(total_orders - (slope * month_numeric + intercept), 2)))')} AS rmse,"
    " COUNT(*) AS test_months FROM split_category_months s JOIN category_lines l ON s.category = l.category"
    " WHERE NOT is_train GROUP BY s.category",
    "ml05_rmse": f"SELECT {_six('sqrt(avg(pow(residual, 2)))')} AS rmse, COUNT(residual) AS test_months FROM predictions",
}


def _needed(sql: str) -> set[str]:
    """Names of the common table expressions a statement uses, directly or through others."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+WHERE", text):
                found.add(name)
                todo.append(body)
    return found


def _statement(select: str) -> str:
    needed = _needed(select)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in needed)
    return f"WITH {parts}\n{select}"


def all_oracles() -> dict[str, str]:
    return {name: _statement(select) for name, select in SELECTS.items()}
