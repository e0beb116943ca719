"""Reading, writing, registering, compacting; layout and log."""

import logging

import pytest
from pyspark.sql import functions as F

from tradewind.config import Layout
from tradewind.plans.audit import ERROR, PARTIAL, SKIPPED, SUCCESS, RunLog, log_step, monitoring_entry
from tradewind.sources import tables


def test_layout_paths():
    layout = Layout("/data/", gold="/elsewhere/gold")
    assert layout.path("silver", "orders") == "/data/silver/orders"
    assert layout.path("gold") == "/elsewhere/gold"
    with pytest.raises(ValueError, match="unknown layer"):
        layout.path("platinum")


def test_overwrite_counts_and_replaces_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.overwrite(spark.range(10), path) == 10
    assert tables.overwrite(spark.range(3).select(F.col("id").cast("string").alias("name")), path) == 3
    assert tables.read_layer(spark, path).columns == ["name"]
    assert tables.overwrite(spark.range(10).filter("false"), path) == 0


def test_an_overwritten_path_is_plain_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(spark.range(4), path)
    assert spark.read.parquet(path).count() == tables.read_layer(spark, path).count() == 4


def test_overwrite_refuses_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(spark.range(5), path)
    with pytest.raises(ValueError, match="new version"):
        tables.overwrite(tables.read_layer(spark, path), path, sources=[path])
    with pytest.raises(ValueError):
        tables.overwrite(spark.range(1), str(tmp_path), sources=[path])
    assert tables.read_layer(spark, path).count() == 5


@pytest.fixture
def name(spark):
    """The name of a table that is gone after the test."""
    yield "published_numbers"
    for table in ("published_numbers", "published_numbers__next"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_published_versions_are_read_by_name_and_by_location(spark, tmp_path, name):
    path, places = str(tmp_path / "it's here"), []
    for n in range(1, 6):
        counted = tables.publish(spark.range(n), name, path, metrics={"even": "count_if(id % 2 = 0)"})
        assert counted == {"rows": n, "even": (n + 1) // 2}
        places.append(tables.location(spark, name))
        assert spark.table(name).count() == spark.read.parquet(places[-1]).count() == n
    assert [p.rpartition("/")[2] for p in places] == ["v0", "v1", "v2", "v0", "v1"]
    assert sorted(p.name for p in (tmp_path / "it's here").iterdir()) == ["v0", "v1", "v2"]  # no more than the folders in turn
    assert not spark.catalog.tableExists(f"{name}__next")


def test_a_reader_keeps_its_version(spark, tmp_path, name):
    tables.publish(spark.range(3), name, str(tmp_path))
    slow = spark.table(name)
    for n in (7, 8):
        tables.publish(spark.range(n), name, str(tmp_path))
        assert slow.count() == 3


def test_a_table_may_be_made_from_itself(spark, tmp_path, name):
    tables.publish(spark.range(3), name, str(tmp_path))
    for n in (6, 12, 24):
        before = tables.read_table(spark, name)
        assert tables.publish(before.unionAll(before), name, str(tmp_path))["rows"] == n
    assert spark.table(name).count() == 24


def test_a_failed_publication_leaves_the_table(spark, tmp_path, name):
    tables.publish(spark.range(7), name, str(tmp_path))
    before = tables.location(spark, name)
    broken = spark.range(9).select(F.expr("IF(id = 8, CAST(raise_error('no') AS BIGINT), id)").alias("id"))
    for bad in (broken, broken.withColumn("more", F.lit(1))):
        with pytest.raises(Exception, match="no"):
            tables.publish(bad, name, str(tmp_path))
        assert tables.location(spark, name) == before and spark.table(name).count() == 7
        assert not spark.catalog.tableExists(f"{name}__next")
    assert tables.publish(spark.range(8), name, str(tmp_path))["rows"] == 8


def test_publishing_replaces_the_schema_and_keeps_the_properties(spark, tmp_path, name):
    tables.publish(spark.range(3), name, str(tmp_path), properties=tables.gold_properties("numbers"))
    wider = spark.range(4).select(F.col("id").cast("string").alias("name"), F.array(F.lit(1)).alias("odd"), F.lit(None).cast("date").alias("day"))
    tables.publish(wider, name, str(tmp_path))
    assert spark.table(name).dtypes == wider.dtypes and spark.table(name).count() == 4
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert properties["business_ready"] == "true"
    assert tables.publish(wider.limit(0), name, str(tmp_path))["rows"] == 0 and spark.table(name).count() == 0


def test_buckets_spare_the_exchanges(spark, tmp_path, name):
    lines = spark.range(600).select((F.col("id") % 90).alias("order_id"), F.col("id").alias("line"))
    for _ in range(2):  # the second time the entry is pointed to new files
        tables.publish(lines, name, str(tmp_path), buckets=(4, ["order_id"]))
    stored = spark.table(name)
    grouped = stored.groupBy("order_id").count()
    assert sorted(stored.collect()) == sorted(lines.collect())
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert grouped.where("count in (6, 7)").count() == 90
    tables.publish(lines, name, str(tmp_path))  # without buckets again
    assert "Exchange" in spark.table(name).groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()


def test_append_and_merged_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.range(2), path)
    tables.append(spark.range(2).withColumn("note", F.lit("x")), path)
    merged = tables.read_layer(spark, path, merge_schema=True)
    assert set(merged.columns) == {"id", "note"} and merged.filter("note IS NULL").count() == 2


def test_register_properties_and_repointing(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    tables.overwrite(spark.range(4), one)
    tables.overwrite(spark.range(6), two)
    tables.register(spark, "registered_numbers", one, properties=tables.silver_properties("numbers"))
    assert tables.read_table(spark, "registered_numbers").count() == 4
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES registered_numbers").collect()}
    assert properties["layer"] == "silver" and properties["data_quality_validated"] == "true"
    tables.register(spark, "registered_numbers", two, properties=tables.gold_properties("numbers"))
    assert spark.table("registered_numbers").count() == 6
    spark.sql("DROP TABLE registered_numbers")


def test_rewrite_clustered(spark, tmp_path):
    path = str(tmp_path / "daily")
    days = spark.range(200).select((F.col("id") * 37 % 200).alias("order_date"), F.lit(1).alias("x"))
    tables.publish(days.repartition(5), "gold_daily_sales", path, properties=tables.gold_properties("daily_sales"))
    before = tables.location(spark, "gold_daily_sales")
    version = tables.rewrite_clustered(spark, "gold_daily_sales", path, files=4)
    assert version != before and sorted(spark.table("gold_daily_sales").collect()) == sorted(days.collect())
    assert all(version.split(":")[-1] in f for f in spark.table("gold_daily_sales").inputFiles())
    with pytest.raises(ValueError):
        tables.rewrite_clustered(spark, "something_else", path)
    spark.sql("DROP TABLE gold_daily_sales")


def test_registration_follows_the_columns_of_the_files(spark, tmp_path):
    path = str(tmp_path / "it's daily")
    tables.overwrite(spark.range(50).withColumnRenamed("id", "order_date"), path)
    tables.register(spark, "gold_daily_sales", path, properties=tables.gold_properties("daily_sales"))
    wider = spark.range(80).select(F.col("id").alias("order_date"), (F.col("id") * 2).alias("revenue"), F.lit("x").alias("note"))
    tables.overwrite(wider, path)
    tables.register(spark, "gold_daily_sales", path)
    assert spark.table("gold_daily_sales").columns == ["order_date", "revenue", "note"]
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES gold_daily_sales").collect()}
    assert properties["business_ready"] == "true"
    assert sorted(spark.table("gold_daily_sales").collect()) == sorted(wider.collect())
    spark.sql("DROP TABLE gold_daily_sales")


def test_preview_drops_metadata(spark):
    columns = [F.lit(n).alias(f"c{n}") for n in range(12)]
    df = spark.range(9).select("id", F.lit(0).alias("bronze_x"), F.lit(0).alias("silver_y"), *columns)
    shown = tables.preview(df, ["id"])
    assert shown.columns == ["id", *[f"c{n}" for n in range(9)]]
    assert [r.id for r in shown.collect()] == [0, 1, 2]


def test_to_driver_refuses_to_cut(spark):
    assert len(tables.to_driver(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        tables.to_driver(spark.range(5), 4)


def test_log_line(caplog):
    with caplog.at_level(logging.INFO, "tradewind"):
        line = log_step("Load", "SUCCESS", "3 rows")
    assert line.endswith("Load: SUCCESS - 3 rows") and line.startswith("[") and line in caplog.text
    assert log_step("Load", "STARTED").endswith("Load: STARTED")


def test_monitoring_entry(spark, tmp_path):
    path = str(tmp_path / "m")
    tables.append(monitoring_entry(spark, "Load", "SUCCESS", 3), path)
    tables.append(monitoring_entry(spark, "Clean", "ERROR", error_message="broken", details="why"), path)
    rows = {r.step_name: r for r in tables.read_layer(spark, path).collect()}
    assert rows["Load"].record_count == 3 and rows["Load"].timestamp is not None
    assert (rows["Clean"].error_message, rows["Clean"].details) == ("broken", "why")


def test_run_log_skips_dependents(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "m"))

    def fail():
        raise RuntimeError("no input")

    assert log.step("a_one", lambda: 5).status == SUCCESS
    assert log.step("a_two", fail).status == ERROR
    assert log.step("b_one", lambda: 7, needs=["a_one"]).status == SUCCESS
    assert log.step("b_two", lambda: 9, needs=["a_one", "a_two"]).status == SKIPPED
    assert (log.total(), log.total("a_"), log.status("b_"), log.status()) == (12, 5, PARTIAL, PARTIAL)
    with pytest.raises(RuntimeError):
        log.step("c", fail, reraise=True)
    log.summarize("Layer a", "a_", "done")
    assert "Layer a" not in log.outcomes
    assert tables.read_layer(spark, str(tmp_path / "m")).count() == 6
