"""What the plans look like, and what must hold between results."""

import pytest

from registry.queries import Shop, all_queries
from tradewind.plans import gold, insights, kpis, quality
from tradewind.sources import retail

QUERIES = all_queries()


@pytest.fixture(scope="module")
def shop(spark, small_dir):
    return Shop(spark, small_dir)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_crosses_tables_or_leaves_the_jvm(spark, small_dir, name):
    plan = physical(QUERIES[name](spark, small_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark, shop, tmp_path):
    path = str(tmp_path / "orders")
    shop.silver["orders"].write.parquet(path)
    plan = physical(gold.monthly_sales(spark.read.parquet(path)))
    assert "EqualTo(status,completed)" in plan
    schema = plan[plan.index("ReadSchema"):]
    assert "customer_id" in schema and "payment_method" not in schema


def test_hot_groups_are_cut_before_every_shuffle(shop):
    # Each exchange of the item reports sits on a partial aggregation or a per-task limit.
    plan = physical(gold.product_sales(shop.sales)).splitlines()
    for place, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = " ".join(plan[place + 1:place + 3])
            assert "partial_" in below or "WindowGroupLimit" in below


def scans(df, table):
    return physical(df).count(f"{table}.parquet")


def test_category_sales_read_the_lines_once(shop):
    plan = shop.categories
    assert "Expand" not in physical(plan) and scans(plan, "lineitem") == 1 and scans(plan, "orders") == 1


def test_a_histogram_computes_its_input_once(spark, tmp_path):
    """Counted by an accumulator in the input: each row is computed for one of both uses."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(1000, numPartitions=4).select((F.col("id") % 70).cast("double").alias("avg_order_value")).mapInArrow(seen, "avg_order_value double")
    histogram = insights.order_value_histogram(df)
    assert calls.value == 0
    assert sum(r.customer_count for r in histogram.collect()) == 1000 and calls.value == 1000


def test_the_rank_computes_the_figures_once(shop):
    plan = gold.product_analytics(shop.silver["products"], shop.sales, retail.AS_OF, retail.THRESHOLDS)
    text = physical(plan)
    # Every scan of the lines is inside what is kept, which has one of them.
    assert text.count("InMemoryRelation") >= 4 and text.count("lineitem.parquet") == text.count("InMemoryRelation")


def test_kept_rows_go_with_the_result(spark):
    from tradewind.operators.reuse import computed_once

    def stored():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before = stored()
    result = computed_once(spark.range(100).selectExpr("id % 7 AS k"), lambda df: df.join(df.groupBy("k").count(), "k"))
    assert result.count() == 100 and stored() == before + 1
    derived = result.where("k = 1")
    del result
    assert stored() == before and derived.count() == 15


def test_raw_checks_read_a_table_once_per_key(shop):
    plan = quality.raw_checks(shop.raw)
    assert scans(plan, "part") == 1 and scans(plan, "orders") == 1 and scans(plan, "lineitem") == 1
    assert scans(plan, "customer") == 2  # by id, and by e-mail address


def test_key_figures_and_lineage_read_each_table_few_times(spark, shop, small_dir):
    figures = QUERIES["gk01_business_kpis"](spark, small_dir)
    assert scans(figures, "lineitem") == 1 and scans(figures, "part") == 1 and scans(figures, "orders") <= 3
    executive = QUERIES["an14_executive_metrics"](spark, small_dir)
    assert scans(executive, "lineitem") == 1 and scans(executive, "part") == 1 and scans(executive, "orders") <= 3
    lineage = QUERIES["au05_lineage"](spark, small_dir)
    assert [scans(lineage, t) for t in ("part", "orders", "lineitem")] == [2, 2, 2]


def test_the_rank_starts_no_job_and_no_checkpoint(spark, shop):
    group = "rank-plan"
    spark.sparkContext.setJobGroup(group, "")
    try:
        plan = gold.product_analytics(shop.silver["products"], shop.sales, retail.AS_OF, retail.THRESHOLDS)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
        assert "ExistingRDD" not in physical(plan)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_cohort_of_any_age_keeps_its_rates(spark):
    rows = [("1990-01", 0, 100.0), ("1990-01", 100, 25.0), ("1998-01", 0, 100.0), ("1998-01", 1, None)]
    cohorts = spark.createDataFrame(rows, "cohort_month string, months_since_first_purchase int, retention_rate double")
    group = spark.sparkContext
    group.setJobGroup("matrix-plan", "")
    try:
        matrix, narrow = insights.retention_matrix(cohorts), insights.retention_table(cohorts, [0, 1])
        assert list(group.statusTracker().getJobIdsForGroup("matrix-plan")) == []
    finally:
        group.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in matrix.collect()] == [("1990-01", {0: 100.0, 100: 25.0}), ("1998-01", {0: 100.0, 1: None})]
    assert insights.retention_rates(cohorts).count() == 4
    with pytest.raises(Exception, match="1990-01 has rates for months that are not among the columns: 100"):
        narrow.collect()
    wide = insights.retention_table(cohorts, range(101)).collect()
    assert (wide[0].month_100, wide[0].month_1, wide[1].month_0) == (25.0, None, 100.0)


def test_an_inner_age_that_is_not_named_is_not_lost(spark):
    rows = [("2000-01", age, 50.0) for age in (0, 1, 2)]
    cohorts = spark.createDataFrame(rows, "cohort_month string, months_since_first_purchase int, retention_rate double")
    with pytest.raises(Exception, match="columns: 1"):
        insights.retention_table(cohorts, [0, 2]).collect()


def test_revenue_adds_up_over_every_cut(shop):
    done = gold.completed(shop.silver["orders"]).selectExpr("SUM(CAST(order_total AS DECIMAL(18,2))) AS s").first().s
    for df in (shop.months, shop.days):
        assert df.selectExpr("SUM(CAST(total_revenue AS DECIMAL(18,2))) AS s").first().s == done
    totals = {r.metric_name: r.metric_number for r in kpis.business_kpis(shop.customers, shop.products, shop.months, shop.categories).collect()}
    assert totals["Total Revenue"] == float(done)


def test_cohorts_start_complete_and_partition_the_customers(shop):
    rows = shop.monthly_cohorts.collect()
    assert {r.retention_rate for r in rows if r.months_since_first_purchase == 0} == {100.0}
    assert all(r.active_customers <= r.cohort_size for r in rows)
    started = sum(r.cohort_size for r in rows if r.months_since_first_purchase == 0)
    buyers = gold.completed(shop.silver["orders"]).join(shop.silver["customers"], "customer_id", "left_semi")
    assert started == buyers.select("customer_id").distinct().count()


def test_rank_is_a_permutation(shop):
    ranks = sorted(r.revenue_rank for r in shop.ranked_products.select("revenue_rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_every_class_occurs_in_the_test_data(spark):
    mid = Shop(spark, "/root/testdata/sf0.01")
    expected = {
        (mid.silver["products"], "price_category"): 4,
        (mid.silver["products"], "availability_status"): 3,
        (mid.silver["orders"], "order_value_category"): 4,
        (mid.silver["order_items"], "unit_price_category"): 4,
        (mid.silver["order_items"], "discount_category"): 4,
        (mid.silver["customers"], "customer_lifetime_category"): 3,
        (mid.customers, "value_segment"): 5,
        (mid.products, "sales_performance"): 5,
        (mid.products, "demand_level"): 5,
    }
    for (df, column), count in expected.items():
        assert df.select(column).distinct().count() == count, column


@pytest.mark.parametrize("partitions", [1, 64])
def test_results_do_not_depend_on_partitions(shop, partitions):
    s = {t: shop.silver[t].repartition(partitions) for t in ("customers", "products", "orders", "order_items")}
    sales = gold.sales_lines(s["orders"], s["order_items"])
    moved = gold.customer_analytics(s["customers"], s["orders"], sales, s["products"], retail.AS_OF, retail.THRESHOLDS)
    assert sorted(moved.collect()) == sorted(shop.customers.collect())
    assert gold.category_sales(sales, s["products"]).collect() == shop.categories.collect()


def test_skewed_keys_give_whole_results(spark):
    """One customer, one product and one order hold a third of the rows each; checked by brute force."""
    n = 3000
    orders = spark.range(n).selectExpr(
        "id AS order_id", "IF(id % 3 = 0, 1, id % 50) AS customer_id", "'completed' AS status",
        "date_add(DATE '2020-01-01', CAST(id % 400 AS INT)) AS order_date", "CAST(id % 90 AS DOUBLE) AS order_total",
    )
    items = spark.range(3 * n).selectExpr(
        f"IF(id % 3 = 0, 7, id % {n}) AS order_id", "IF(id % 3 = 1, 5, id % 40) AS product_id", "1 AS quantity",
        "2.5D AS line_total_corrected", "0.0D AS discount_amount", "2.5D AS unit_price",
    )
    found = {r.product_id: r for r in gold.product_sales(gold.sales_lines(orders, items)).collect()}
    buyer = {r.order_id: r.customer_id for r in orders.collect()}
    expected = {}
    for r in items.collect():
        entry = expected.setdefault(r.product_id, [0, set(), set()])
        entry[0] += 1
        entry[1].add(r.order_id)
        entry[2].add(buyer[r.order_id])
    assert {k: (r.total_quantity_sold, r.unique_orders, r.unique_customers) for k, r in found.items()} == {
        k: (c, len(o), len(b)) for k, (c, o, b) in expected.items()
    }
    assert all(r.total_revenue == 2.5 * r.total_quantity_sold for r in found.values())
