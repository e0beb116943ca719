"""A whole run over stored layers, and what happens when a table is missing or broken."""

import pytest
from pyspark.sql import functions as F

from tradewind.config import TABLES, Layout
from tradewind.plans import medallion
from tradewind.plans.audit import ERROR, SKIPPED, SUCCESS
from tradewind.sources import retail, tables

import __spark_entry__ as entry_module
from compare import canonical


def settings(root, database=None):
    return medallion.Settings(
        Layout(str(root)), retail.AS_OF, retail.THRESHOLDS, retail.SURVIVOR_ORDER, database=database
    )


def store_raw(spark, layout, directory, skip=()):
    for table, read in retail.RAW_TABLES.items():
        if table not in skip:
            tables.overwrite(read(spark, directory), layout.path("raw", table))


@pytest.fixture(scope="module")
def finished(spark, small_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    spark.sql("CREATE DATABASE IF NOT EXISTS whole_run")
    chosen = settings(root, "whole_run")
    store_raw(spark, chosen.layout, small_dir)
    run = medallion.Medallion(spark, chosen)
    yield run, run.run(), chosen
    spark.sql("DROP DATABASE whole_run CASCADE")


def test_every_step_succeeds(finished):
    _, report, _ = finished
    assert {o.status for o in report.log.outcomes.values()} == {SUCCESS}
    assert report.status == SUCCESS
    assert len(report.cross_checks.collect()) == 4
    assert {r.status for r in report.gold_quality.collect()} == {"PASS"}


def test_counts_come_from_the_writes(spark, finished):
    run, report, _ = finished
    for layer, names in (("bronze", TABLES), ("silver", TABLES), ("gold", medallion.GOLD_TABLES)):
        for name in names:
            assert report.log.outcomes[f"{layer}_{name}"].records == run.read(layer, name).count()


@pytest.mark.parametrize(
    ("table", "query"),
    [
        ("customer_analytics", "gc04_customer_analytics"), ("product_analytics", "gp09_product_analytics"),
        ("monthly_sales", "gs01_monthly_sales"), ("daily_sales", "gs06_daily_sales"),
        ("category_sales", "gs07_category_sales"), ("cohort_analysis", "gh03_cohort_analysis"),
        ("cohort_by_month", "gh06_cohort_by_month"),
    ],
)
def test_stored_gold_equals_the_queries(spark, finished, small_dir, table, query):
    _, _, chosen = finished
    stored = spark.table(f"{chosen.database}.gold_{table}")
    assert {"gold_created_timestamp", "gold_created_date", "analytics_version"} <= set(stored.columns)
    assert ("last_updated" in stored.columns) == (table in ("customer_analytics", "product_analytics"))
    direct = entry_module.queries()[query](spark, small_dir)
    same = stored.select(*direct.columns)
    assert canonical(same.columns, same.collect()) == canonical(direct.columns, direct.collect())


def test_audit_tables(spark, finished):
    run, report, chosen = finished
    log = tables.read_layer(spark, chosen.layout.path("gold", medallion.MONITORING))
    assert log.count() == len(report.log.outcomes) + 2
    lineage = {r.table_name: r for r in spark.table(f"{chosen.database}.{medallion.LINEAGE}").collect()}
    assert set(lineage) == set(TABLES)
    assert lineage["orders"].record_change == lineage["orders"].silver_records - lineage["orders"].bronze_records
    assert spark.table(f"{chosen.database}.gold_business_kpis").count() == 11


def test_catalog_properties(spark, finished):
    _, _, chosen = finished
    shown = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {chosen.database}.gold_monthly_sales").collect()}
    assert shown["business_ready"] == "true" and shown["analytics_version"] == "1.0"


def test_compaction_keeps_the_rows(spark, finished):
    run, _, chosen = finished
    name = f"{chosen.database}.silver_order_items"
    before = spark.table(name)
    columns, rows = before.columns, sorted(map(str, before.collect()))
    run.compact("silver", "order_items", files=3)
    after = spark.table(name)
    assert after.columns == columns and sorted(map(str, after.collect())) == rows
    assert sorted(map(str, run.read("silver", "order_items").collect())) == rows
    with pytest.raises(ValueError):
        run.compact("silver", "nothing")


def test_all_tables_are_clustered_and_read_back(spark, finished):
    run, report, chosen = finished
    compacted = {n.removeprefix("compact_") for n in report.log.outcomes if n.startswith("compact_")}
    assert compacted == {*[f"silver_{t}" for t in TABLES], *[f"gold_{t}" for t in medallion.CLUSTERED_GOLD]}
    for name in compacted:
        layer, _, table = name.partition("_")
        place = tables.location(spark, f"{chosen.database}.{name}")
        assert chosen.layout.path(layer, table) in place
        assert sorted(map(str, spark.read.parquet(place).collect())) == sorted(map(str, run.read(layer, table).collect()))


def test_checks_of_what_arrived_are_reported(finished):
    _, report, _ = finished
    assert {r.check_name: r.passed for r in report.raw_checks.collect()}["duplicate_customer_ids"] is False
    shown = {r.table_name: r for r in report.bronze_validation.collect()}
    assert set(shown) == set(TABLES) and all(not r.missing_columns and not r.extra_columns for r in shown.values())
    assert {r.table_name for r in report.bronze_nulls.collect()} == set(TABLES)
    assert all(r.passed for r in report.money_scale.collect())


def test_checks_on_the_way_equal_those_of_the_stored_tables(spark, finished):
    """What the writes counted, against one look at each table as it is stored."""
    from tradewind.plans import bronze, quality

    run, report, _ = finished
    silver = {t: run.read("silver", t) for t in TABLES}
    assert sorted(report.silver_rules.collect()) == sorted(quality.silver_rule_results(silver).collect())
    assert sorted(report.money_scale.collect()) == sorted(quality.money_scale_checks(silver).collect())
    gold_tables = {t: run.read("gold", t) for t in medallion.GOLD_TABLES}
    assert sorted(report.gold_quality.collect()) == sorted(quality.gold_assessment(gold_tables).collect())
    nulls = bronze.union_reports([bronze.null_counts(run.read("raw", t), t) for t in TABLES])
    assert sorted(report.bronze_nulls.collect()) == sorted(nulls.collect()) and any(r.null_count for r in nulls.collect())


def test_the_checks_of_the_run_read_no_table_but_for_uniqueness(spark, finished, monkeypatch):
    run, _, _ = finished
    read, asked = run.read, []
    monkeypatch.setattr(run, "read", lambda layer, table: asked.append(f"{layer}_{table}") or read(layer, table))
    verdicts = run.check_silver()
    run.check_gold()
    run.check_money()
    assert len(verdicts.collect()) == sum(map(len, medallion.quality.SILVER_RULES.values()))
    assert sorted(asked) == sorted(f"silver_{t}" for t in TABLES)  # handed on, and looked at for uniqueness alone
    sc = spark.sparkContext
    sc.setJobGroup("verdicts", "")
    try:
        run.check_gold()
        quality_job_ids = list(sc.statusTracker().getJobIdsForGroup("verdicts"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert quality_job_ids == []


def test_a_rule_that_fails_on_the_data_does_not_stop_the_write(spark, small_dir, tmp_path, monkeypatch):
    from dataclasses import replace

    from tradewind.operators.rules import Rule

    spark.sql("CREATE DATABASE IF NOT EXISTS failing_rule")
    chosen = replace(settings(tmp_path, "failing_rule"), clustered=False)
    store_raw(spark, chosen.layout, small_dir)
    rules = {**medallion.quality.SILVER_RULES, "orders": (Rule("breaks", "CAST(status AS INT) > 0"), *medallion.quality.SILVER_RULES["orders"])}
    monkeypatch.setattr(medallion.quality, "SILVER_RULES", rules)
    report = medallion.run(spark, chosen)
    assert {o.status for o in report.log.outcomes.values()} == {SUCCESS}
    found = {r.rule_name: r.passed for r in report.silver_rules.filter("table_name = 'orders'").collect()}
    assert found.pop("breaks (error)") is False and set(found.values()) == {True}
    spark.sql("DROP DATABASE failing_rule CASCADE")


def test_bucketed_orders_join_without_an_exchange(spark, small_dir, tmp_path):
    from dataclasses import replace

    from tradewind.plans import gold

    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed_run")
    chosen = replace(settings(tmp_path, "bucketed_run"), order_buckets=6)
    store_raw(spark, chosen.layout, small_dir)
    run = medallion.Medallion(spark, chosen)
    report = run.run()
    assert report.status == SUCCESS and not {"compact_silver_orders", "compact_silver_order_items"} & set(report.log.outcomes)
    orders, items = run.read("silver", "orders"), run.read("silver", "order_items")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = gold.sales_lines(orders, items)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        plain = gold.sales_lines(orders.repartition(3), items.repartition(5))
        assert sorted(joined.collect()) == sorted(plain.collect()) == sorted(run.read("gold", medallion.SALES).collect())
        totals = medallion.quality.order_total_mismatches(orders, items)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in totals
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP DATABASE bucketed_run CASCADE")


def test_reports_are_read_from_the_stored_tables(spark, finished, small_dir):
    run, _, _ = finished
    found = run.reports()
    for name, query in (
        ("retention_rates", "an12_retention_rates"), ("cohort_sizes", "an13_cohort_start_sizes"),
        ("executive_metrics", "an14_executive_metrics"), ("order_value_histogram", "an16_order_value_histogram"),
    ):
        direct = entry_module.queries()[query](spark, small_dir)
        assert canonical(direct.columns, found[name]().select(*direct.columns).collect()) == canonical(direct.columns, direct.collect())
    assert all(build().columns for build in found.values())


def test_required_rules_can_stop_the_run_before_gold(spark, small_dir, tmp_path, monkeypatch):
    from dataclasses import replace

    from tradewind.operators.rules import Rule

    spark.sql("CREATE DATABASE IF NOT EXISTS required_run")
    chosen = replace(settings(tmp_path, "required_run"), required=True, clustered=False)
    store_raw(spark, chosen.layout, small_dir)
    monkeypatch.setattr(medallion.quality, "REQUIRED_CUSTOMER_RULES", (Rule("never", "customer_id < 0"),))
    report = medallion.run(spark, chosen)
    states = {name: o.status for name, o in report.log.outcomes.items()}
    assert states[medallion.REQUIRED] == ERROR and states["silver_orders"] == SUCCESS
    assert {s for n, s in states.items() if n.startswith("gold_")} == {SKIPPED}
    spark.sql("DROP DATABASE required_run CASCADE")


def test_missing_raw_table_stops_the_ingestion(spark, small_dir, tmp_path):
    chosen = settings(tmp_path)
    store_raw(spark, chosen.layout, small_dir, skip=["products"])
    run = medallion.Medallion(spark, chosen)
    with pytest.raises(Exception):
        run.ingest_to_bronze(chosen.layout.path("raw", "products"), chosen.layout.path("bronze", "products"), "products")
    assert run.log.outcomes["bronze_products"].status == ERROR
    row = tables.read_layer(spark, chosen.layout.path("gold", medallion.MONITORING)).first()
    assert (row.step_name, row.status) == ("bronze_products", "ERROR") and row.error_message


def test_broken_table_only_stops_what_needs_it(spark, small_dir, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS broken_run")
    chosen = settings(tmp_path, "broken_run")
    store_raw(spark, chosen.layout, small_dir, skip=["products"])
    bad = retail.raw_products(spark, small_dir).drop("price").withColumn("other", F.lit(1))
    tables.overwrite(bad, chosen.layout.path("raw", "products"))
    report = medallion.run(spark, chosen)
    states = {name: o.status for name, o in report.log.outcomes.items()}
    assert states["silver_products"] == ERROR
    assert states["gold_customer_analytics"] == states["gold_product_analytics"] == states["gold_category_sales"] == SKIPPED
    assert states["gold_monthly_sales"] == states["gold_daily_sales"] == states["gold_cohort_analysis"] == SUCCESS
    assert states["gold_business_kpis"] == SKIPPED
    assert report.status == "PARTIAL_SUCCESS" and report.cross_checks is None
    spark.sql("DROP DATABASE broken_run CASCADE")
