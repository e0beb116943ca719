"""Deduplication, ranking, layout and rules on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from tradewind.operators.dedup import first_per_key
from tradewind.operators.layout import cluster, cluster_table
from tradewind.operators.ranking import global_rank, small_rank
from tradewind.operators.rules import (
    QualityError, Rule, UniqueRule, check_rules, check_rules_now, quality_scores, require,
)


def keyed(spark, partitions=3):
    rows = [(k, n, f"v{n}") for k in range(50) for n in range(4)] + [(999, n, "hot") for n in range(500)]
    return spark.createDataFrame(rows, "k int, n int, v string").repartition(partitions)


def test_first_per_key_follows_the_order(spark):
    kept = first_per_key(keyed(spark), ["k"], ["n DESC"]).collect()
    assert len(kept) == 51
    assert {(r.k, r.n) for r in kept} == {(k, 3) for k in range(50)} | {(999, 499)}


def test_first_per_key_without_order_does_not_depend_on_partitions(spark):
    results = [sorted(first_per_key(keyed(spark, p), ["k"]).collect()) for p in (1, 4, 64)]
    assert results[0] == results[1] == results[2]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    plan = first_per_key(keyed(spark), ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Partial")
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("order", [["seq"], ["seq DESC"]])
def test_ties_of_the_order_do_not_depend_on_partitions(spark, order):
    rows = [(k, n % 2, n) for k in range(40) for n in range(8)]  # four rows share each (k, seq)
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    results = [sorted(first_per_key(df.repartition(p), ["k"], order).collect()) for p in (1, 4, 16, 64)]
    assert all(r == results[0] for r in results) and len(results[0]) == 40


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_global_rank_equals_a_plain_window(spark, partitions):
    # A third of the rows tie on the value, and some have none.
    value = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97)
    df = spark.range(3000).select("id", value.alias("x")).repartition(partitions)
    ranked = {r.id: r.place for r in global_rank(df, "x", "id", "place").collect()}
    expected = {r.id: r.place for r in df.selectExpr("*", small_rank("x DESC, id") + " AS place").collect()}
    assert ranked == expected
    assert sorted(ranked.values()) == list(range(1, 3001))


def test_global_rank_with_text_keys(spark):
    df = spark.range(500).selectExpr("concat('P', lpad(CAST(id AS STRING), 5, '0')) AS k", "CAST(id % 5 AS DOUBLE) AS x")
    ranked = {r.k: r.place for r in global_rank(df, "x", "k", "place").collect()}
    expected = {r.k: r.place for r in df.selectExpr("*", small_rank("x DESC, k") + " AS place").collect()}
    assert ranked == expected


def test_global_rank_of_nothing(spark):
    df = spark.createDataFrame([], "id int, x int")
    assert global_rank(df, "x", "id", "place").count() == 0


def test_global_rank_cuts_a_value_that_most_rows_share(spark):
    df = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, id, 0) AS x")
    plan = global_rank(df, "x", "id", "place")
    sizes = [r[0] for r in plan.groupBy(F.expr("CAST((place - 1) DIV 500 AS INT)")).count().select("count").collect()]
    assert sizes == [500] * 40
    text = plan._jdf.queryExecution().executedPlan().toString()
    window = text[text.index("Window [row_number()"):]
    assert "__bucket" in window.splitlines()[0] and "__split" in window.splitlines()[0]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_cluster_keeps_rows_and_sorts_files(spark, tmp_path):
    df = keyed(spark)
    clustered = cluster(df, ["k"], ["n"], files=4)
    assert sorted(clustered.collect()) == sorted(df.collect())
    ranges = (
        clustered.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    )
    assert len(ranges) > 1
    assert all(a.hi <= b.lo for a, b in zip(ranges, ranges[1:]))


def test_every_cluster_column_skips_files(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).selectExpr(
        "id AS order_id", "(id * 7919) % 500 AS customer_id", "date_add(DATE '2020-01-01', CAST((id * 31) % 700 AS INT)) AS order_date",
        "concat('c', (id * 13) % 12) AS country",
    )
    for columns in (["order_id", "customer_id", "order_date"], ["customer_id", "country"]):
        path = tmp_path / "_".join(columns)
        cluster(df, columns, files=32).write.parquet(str(path))
        files = [pq.ParquetFile(f) for f in path.glob("*.parquet")]
        assert sum(f.metadata.num_rows for f in files) == 20_000 and len(files) == 32
        for column in columns:
            at = files[0].schema_arrow.get_field_index(column)
            spans = [f.metadata.row_group(0).column(at).statistics for f in files]
            middle = df.selectExpr(f"`{column}` AS x").orderBy("x").offset(10_000).first().x
            read = sum(s.min <= middle <= s.max for s in spans)
            assert read <= 20, (columns, column, read)


def test_cluster_splits_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.lit(1).alias("order_id"), F.lit(1).alias("product_id"), F.col("id").alias("order_item_id")
    )
    sizes = [r["count"] for r in cluster_table(rows, "silver_order_items", 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_rules_count_failures(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (2, None), (None, 0)], "id int, x int")
    rules = [Rule("positive", "x > 0"), UniqueRule("unique", "id"), Rule("present", "id IS NOT NULL")]
    found = {r.rule_name: (r.failed_count, r.passed) for r in check_rules(df, "t", rules).collect()}
    # NULL predicates pass; all NULL ids are one value.
    assert found == {"positive": (2, False), "unique": (1, False), "present": (1, False)}


def test_unique_rule_with_one_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    assert check_rules(df, "t", [UniqueRule("unique", "id")]).first().passed
    both = spark.createDataFrame([(None,), (None,)], "id int")
    assert check_rules(both, "t", [UniqueRule("unique", "id")]).first().failed_count == 1


def test_rules_on_an_empty_table_pass(spark):
    df = spark.createDataFrame([], "id int")
    rules = [Rule("present", "id IS NOT NULL"), UniqueRule("unique", "id")]
    assert all(r.passed and r.failed_count == 0 for r in check_rules(df, "t", rules).collect())


def test_a_rule_that_does_not_fit_is_reported_and_isolated(spark):
    df = spark.createDataFrame([(1,)], "id int")
    rules = [Rule("fine", "id > 0"), Rule("unknown", "missing > 0"), Rule("broken", "id >"), UniqueRule("gone", "missing")]
    found = {r.rule_name: (r.failed_count, r.passed) for r in check_rules(df, "t", rules).collect()}
    assert found == {
        "fine": (0, True), "unknown (error)": (None, False), "broken (error)": (None, False), "gone (error)": (None, False),
    }


def test_a_rule_that_fails_on_the_data_is_isolated_at_run_time(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    rules = [Rule("fine", "s IS NOT NULL"), Rule("number", "CAST(s AS INT) > 0")]
    found = {r.rule_name: r.passed for r in check_rules_now(df, "t", rules).collect()}
    assert found == {"fine": True, "number (error)": False}


def test_quality_scores_and_requirement(spark):
    df = spark.createDataFrame([(1,), (-1,)], "id int")
    results = check_rules(df, "t", [Rule("a", "id > 0"), Rule("b", "id IS NOT NULL"), Rule("c", "id < 9")])
    row = quality_scores(results).first()
    assert (row.rules_passed, row.rules_total, row.quality_score) == (2, 3, 66.7)
    with pytest.raises(QualityError, match="t.a: 1 rows"):
        require(results)
    require(results.filter("passed"))


def test_email_rule_needs_a_dot_and_an_end(spark):
    from tradewind.plans.quality import SILVER_RULES

    rule = SILVER_RULES["customers"][1]
    mails = ["a@b.com", "a@bXcom", "a@b.com!", "no-at.com", "a.b+c@d-e.co.uk"]
    df = spark.createDataFrame([(m,) for m in mails], "email string")
    bad = {r.email for r in df.filter(f"NOT ({rule.predicate})").collect()}
    assert bad == {"a@bXcom", "a@b.com!", "no-at.com"}


def test_money_is_exact_for_any_order_and_size(spark):
    from tradewind.functions.money import micros, money_avg, money_sum

    amounts = [0.1, 0.2, -0.3, 1.005, -12.34, 136.57, None, 1e9 + 0.01, 0.29, 4.35]
    df = spark.createDataFrame([(a,) for a in amounts * 30], "x double")
    sums = {p: df.repartition(p).selectExpr(f"{money_sum('x')} AS s", f"{money_avg('x')} AS a").first() for p in (1, 4, 64)}
    assert len(set(sums.values())) == 1
    whole = [r[0] for r in spark.createDataFrame([(a,) for a in amounts], "x double").selectExpr(micros("x")).collect()]
    assert whole == [100000, 200000, -300000, 1005000, -12340000, 136570000, None, 1000000000010000, 290000, 4350000]
    assert sums[1].s == sum(w for w in whole if w is not None) * 30 / 1_000_000
    # Far beyond 64-bit millionths in total.
    large = spark.range(200_000).selectExpr("9.0e11D AS x").selectExpr(f"{money_sum('x')} AS s").first().s
    assert large == 1.8e17
    assert spark.createDataFrame([(None,)], "x double").selectExpr(f"{money_sum('x')} AS s").first().s is None


def test_money_keeps_amounts_below_a_cent(spark):
    from tradewind.functions.money import money_sum

    df = spark.createDataFrame([(0.004,)] * 1000, "x double")
    assert df.selectExpr(f"{money_sum('x')} AS s").first().s == 4.0


def test_amounts_beyond_the_scale_are_reported(spark):
    from tradewind.plans.quality import money_scale_checks

    orders = spark.createDataFrame([(1.2345, 0.0, None), (0.1234567, 1e13, 2.5)], "order_total double, tax_amount double, shipping_cost double")
    items = spark.createDataFrame([(99.999999, 0.1, 3.0)], "line_total_corrected double, discount_amount double, unit_price double")
    found = {r.check_name: r.failed_count for r in money_scale_checks({"orders": orders, "order_items": items}).collect()}
    assert {k: v for k, v in found.items() if v} == {"orders_order_total_off_scale": 1, "orders_tax_amount_off_scale": 1}


def test_record_hash_is_murmur3_of_the_joined_row(spark):
    from tradewind.functions.text import record_hash

    def murmur3(data, seed=42):
        mask = 0xFFFFFFFF
        rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
        scramble = lambda k: rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h, cut = seed, len(data) // 4 * 4
        words = [int.from_bytes(data[i:i + 4], "little") for i in range(0, cut, 4)]
        # Spark feeds each byte of the tail as a block of its own, sign extended.
        for k in words + [(b - 256 if b > 127 else b) & mask for b in data[cut:]]:
            h = (rotate(h ^ scramble(k), 13) * 5 + 0xE6546B64) & mask
        h ^= len(data)
        h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    df = spark.createDataFrame([(1, "Änne", None), (22, "", "xyz")], "a int, b string, c string")
    found = [r.h for r in df.selectExpr(f"{record_hash(['a', 'b', 'c'])} AS h").collect()]
    assert found == [murmur3("1|Änne".encode()), murmur3(b"22||xyz")]
