"""References, reconciliation, NULLs in gold, raw checks and lineage."""

from tradewind.plans import bronze, quality


def test_orphans_count_rows_and_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    row = quality.orphans("o", child, parent, "k").first()
    assert (row.check_name, row.failed_count, row.passed) == ("o", 3, False)
    assert quality.orphans("o", parent.limit(0), parent, "k").first().failed_count == 0


def test_reconciliation_ignores_orders_without_lines(spark):
    orders = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0), (4, 10.0)], "order_id int, order_total double")
    items = spark.createDataFrame(
        [(1, 4.0), (1, 6.0), (2, 10.02), (3, 10.01), (9, 1.0)], "order_id int, line_total_corrected double"
    )
    row = quality.order_total_mismatches(orders, items).first()
    assert row.failed_count == 1


def test_null_assessment_grades(spark):
    def grade(nulls, rows):
        data = [(None if n < nulls else "c", 1.0) for n in range(rows)]
        df = spark.createDataFrame(data, "category string, total_revenue double")
        return quality.null_assessment(df, "category_sales").first()

    assert [(g.quality_score, g.status) for g in (grade(0, 10), grade(1, 10), grade(2, 10), grade(4, 10))] == [
        (100.0, "PASS"), (90.0, "PASS"), (80.0, "WARNING"), (60.0, "FAIL"),
    ]
    # 89.96 is reported as 90.0 but graded as it is.
    assert (grade(251, 2500).quality_score, grade(251, 2500).status) == (90.0, "WARNING")
    empty = spark.createDataFrame([], "category string, total_revenue double")
    assert quality.null_assessment(empty, "category_sales").first().status == "FAIL"


def test_raw_checks(spark):
    raw = {
        "customers": spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, None)], "customer_id int, email string"),
        "products": spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 1.0)], "product_id int, price double, cost double"),
        "orders": spark.createDataFrame([(1,), (1,), (1,)], "order_id int"),
        "order_items": spark.createDataFrame([(1,), (2,)], "order_item_id int"),
    }
    found = {r.check_name: r.failed_count for r in quality.raw_checks(raw).collect()}
    assert found == {
        "duplicate_customer_ids": 1, "duplicate_customer_emails": 1, "null_customer_values": 2, "duplicate_product_ids": 0,
        "price_not_above_cost": 1, "duplicate_order_ids": 2, "duplicate_order_item_ids": 0,
    }


def test_lineage_of_missing_and_empty_bronze(spark):
    schema = "table_name string, record_count bigint"
    before = spark.createDataFrame([("a", 8), ("b", 0)], schema)
    after = spark.createDataFrame([("a", 7), ("b", 0), ("c", 5)], schema)
    scores = spark.createDataFrame([("a", 75.0)], "table_name string, quality_score double")
    rows = {r.table_name: r for r in quality.lineage_from_counts(before, after, scores).collect()}
    assert [(rows[t].bronze_records, rows[t].record_change, rows[t].change_percentage, rows[t].quality_score) for t in "abc"] == [
        (8, -1, -12.5, 75.0), (0, 0, 0.0, 0.0), (0, 5, 0.0, 0.0),
    ]
    assert len(rows["a"].transformation_rules) == 5


def test_bronze_metadata(spark):
    raw = spark.createDataFrame([("a", None, 1), ("a", "b", None), (None, "b", 1)], "x string, y string, n int")
    rows = bronze.with_metadata(raw, "things").collect()
    assert {(r.source_system, r.source_table, r.data_quality_status) for r in rows} == {("data_generation", "things", "raw")}
    assert len({r.bronze_record_id for r in rows}) == 3
    assert len({r.record_md5 for r in rows}) == 3
    shifted = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    pair = bronze.with_metadata(shifted, "t").collect()
    assert pair[0].record_hash == pair[1].record_hash  # NULLs are skipped
    assert pair[0].record_md5 != pair[1].record_md5  # but not in the digest


def test_bronze_profile(spark):
    df = bronze.with_metadata(spark.createDataFrame([(1, None), (1, "x"), (None, None), (None, "y")], "k int, v string"), "t")
    nulls = {r.column_name: r.null_count for r in bronze.null_counts(df, "t").collect()}
    assert nulls["k"] == 2 and nulls["v"] == 2 and nulls["source_table"] == 0
    assert not any(name.startswith("bronze_") for name in nulls)
    report = bronze.validation_report(df, "t", ["k", "v", "w"], ["k"]).first()
    assert (report.record_count, report.duplicate_count, report.missing_columns) == (4, 2, ["w"])
    assert "bronze_record_id" in report.extra_columns and report.column_count == len(df.columns)
    empty = bronze.duplicate_count(df.limit(0), "t", ["k"]).first()
    assert (empty.record_count, empty.duplicate_count) == (0, 0)
