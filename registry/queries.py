"""One query per operator (or per table, where operators are columns of one table).

Each takes (spark, directory of the test tables) and returns a DataFrame over the whole tables. Columns
that hold the time of the run, and row ids and digests that SQL cannot repeat, are left out where the query is checked
against SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from tradewind.functions.sql import aggregate, replace
from tradewind.functions.text import record_hash, record_md5
from tradewind.operators.layout import cluster_table
from tradewind.operators.rules import check_rules, quality_scores
from tradewind.plans import bronze, forecast, gold, insights, kpis, quality, silver
from tradewind.sources import retail, tables

Query = Callable[[SparkSession, str], DataFrame]

# Digest columns whose text form is the same in every SQL engine (no doubles).
DIGEST_COLUMNS = {
    "customers": (
        "customer_id", "first_name", "last_name", "email", "registration_date", "country", "city", "age",
        "customer_segment", "ingest_seq",
    ),
    "products": ("product_id", "product_name", "category", "sub_category", "brand", "dimensions", "stock_quantity", "supplier"),
    "orders": ("order_id", "customer_id", "order_date", "status", "payment_method", "shipping_method", "ingest_seq"),
    "order_items": ("order_item_id", "order_id", "product_id", "quantity", "supplier_id"),
}
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id"}
# A fixed time for the columns that hold the time of a run.
LOADED_AT = "TIMESTAMP '2001-08-02 12:30:00'"


class OnDemand(Mapping):
    """Named frames, each built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass(frozen=True)
class Shop:
    """All layers over one directory of test tables, built when first asked for."""

    spark: SparkSession
    directory: str

    @cached_property
    def raw(self) -> OnDemand:
        return OnDemand({t: lambda r=read: r(self.spark, self.directory) for t, read in retail.RAW_TABLES.items()})

    @cached_property
    def bronze(self) -> OnDemand:
        return OnDemand({t: lambda t=t: bronze.with_metadata(self.raw[t], t) for t in self.raw})

    @cached_property
    def silver(self) -> OnDemand:
        order, raw = retail.SURVIVOR_ORDER, self.raw
        return OnDemand(
            {
                "customers": lambda: silver.clean_customers(raw["customers"], retail.AS_OF, order["customers"]),
                "products": lambda: silver.clean_products(raw["products"], order["products"]),
                "orders": lambda: silver.clean_orders(raw["orders"], retail.AS_OF, retail.THRESHOLDS, order["orders"]),
                "order_items": lambda: silver.clean_order_items(
                    raw["order_items"], retail.THRESHOLDS, order["order_items"]
                ),
            }
        )

    @cached_property
    def sales(self) -> DataFrame:
        return gold.sales_lines(self.silver["orders"], self.silver["order_items"])

    @cached_property
    def customers(self) -> DataFrame:
        s = self.silver
        return gold.customer_analytics(
            s["customers"], s["orders"], self.sales, s["products"], retail.AS_OF, retail.THRESHOLDS
        )

    @cached_property
    def products(self) -> DataFrame:
        return gold.product_figures(self.silver["products"], self.sales, retail.AS_OF, retail.THRESHOLDS)

    @cached_property
    def customer_standing(self) -> DataFrame:
        return gold.customer_standing(self.silver["customers"], self.silver["orders"], retail.AS_OF, retail.THRESHOLDS)

    @cached_property
    def product_standing(self) -> DataFrame:
        return gold.product_standing(self.silver["products"], self.sales)

    @cached_property
    def ranked_products(self) -> DataFrame:
        return gold.product_analytics(self.silver["products"], self.sales, retail.AS_OF, retail.THRESHOLDS)

    @cached_property
    def months(self) -> DataFrame:
        return gold.monthly_sales(self.silver["orders"])

    @cached_property
    def days(self) -> DataFrame:
        return gold.daily_sales(self.silver["orders"])

    @cached_property
    def categories(self) -> DataFrame:
        return gold.category_sales(self.sales, self.silver["products"])

    @cached_property
    def cohorts(self) -> DataFrame:
        return gold.cohort_analysis(self.silver["customers"], self.silver["orders"])

    @cached_property
    def monthly_cohorts(self) -> DataFrame:
        return gold.cohort_by_month(self.silver["customers"], self.silver["orders"])

    @cached_property
    def split_category_months(self) -> DataFrame:
        months = gold.category_months(self.sales, self.silver["products"])
        return forecast.with_split(forecast.with_month_number(months), by=["category"])

    @cached_property
    def split_months(self) -> DataFrame:
        return forecast.with_split(forecast.with_month_number(self.months))


def _comparable(df: DataFrame) -> DataFrame:
    """Silver without the time of the run, the rule list as text."""
    return df.selectExpr(
        "* EXCEPT (silver_processed_timestamp, silver_processed_date, cleaning_rules_applied)",
        "array_join(cleaning_rules_applied, ',') AS cleaning_rules_applied",
    )


def _bronze_table(shop: Shop, table: str) -> DataFrame:
    return shop.bronze[table].selectExpr(
        "* EXCEPT (bronze_ingestion_timestamp, bronze_ingestion_date, record_hash, bronze_record_id, record_md5)",
        f"{record_md5(DIGEST_COLUMNS[table])} AS record_md5",
    )


def _bronze_validation(shop: Shop) -> DataFrame:
    """Raw orders are expected with one column they lack; bronze metadata shows up as extra."""
    expected = [*shop.raw["orders"].columns, "coupon_code"]
    report = bronze.validation_report(shop.bronze["orders"], "orders", expected, [KEYS["orders"]])
    lists = ("expected_columns", "actual_columns", "missing_columns", "extra_columns")
    joined = [f"array_join({c}, ',') AS {c}" for c in lists]
    return report.selectExpr("table_name", "record_count", "column_count", "duplicate_count", *joined)


def _lineage(shop: Shop) -> DataFrame:
    return quality.lineage(shop.bronze, shop.silver).selectExpr(
        "* EXCEPT (lineage_timestamp, transformation_rules)",
        "array_join(transformation_rules, ',') AS transformation_rules",
    )


def _gold_tables(shop: Shop) -> dict[str, DataFrame]:
    return {
        "customer_analytics": shop.customers,
        "product_analytics": shop.products,
        "monthly_sales": shop.months,
        "daily_sales": shop.days,
        "category_sales": shop.categories,
        "cohort_analysis": shop.cohorts,
    }


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Results of floating-point fits, cut to six decimals for comparison."""
    return replace(df, {c: f"floor({c} * 1e6D + 0.5D) / 1e6D" for c in columns})


def _model_forecast(shop: Shop) -> DataFrame:
    return _rounded(forecast.model_predictions(shop.split_months), "prediction")


def _bronze_full(shop: Shop) -> DataFrame:
    """Bronze orders as of a fixed time; both digests over the columns that read alike as text in every engine."""
    return bronze.with_metadata(shop.raw["orders"], "orders", LOADED_AT).selectExpr(
        "* EXCEPT (bronze_ingestion_timestamp, record_hash, record_md5, bronze_record_id)",
        "CAST(bronze_ingestion_timestamp AS STRING) AS bronze_ingestion_timestamp",
        f"{record_hash(DIGEST_COLUMNS['orders'])} AS record_hash",
        f"{record_md5(DIGEST_COLUMNS['orders'])} AS record_md5",
        "bronze_record_id IS NOT NULL AND bronze_record_id >= 0 AS has_record_id",
    )


def _record_hashes(shop: Shop) -> DataFrame:
    """The Murmur3 hash of every raw order."""
    return shop.raw["orders"].selectExpr("order_id", "ingest_seq", f"{record_hash(DIGEST_COLUMNS['orders'])} AS record_hash")


def _stamps(df: DataFrame, keys: tuple[str, ...], updated: bool) -> DataFrame:
    """Gold metadata as of a fixed time, times as text."""
    stamped = gold.with_metadata(df.select(*keys), LOADED_AT, updated)
    moments = ["gold_created_timestamp", *(["last_updated"] if updated else [])]
    return replace(stamped, {c: f"CAST({c} AS STRING)" for c in moments})


def _retention_matrix(shop: Shop) -> DataFrame:
    """The matrix, its rates as text: age=rate with two decimals, by age."""
    rates = "transform(map_entries(rates), e -> concat(e.key, '=', CAST(e.value AS DECIMAL(18,2))))"
    return insights.retention_matrix(shop.monthly_cohorts).selectExpr("cohort_month", f"array_join({rates}, ' ') AS rates")


def _feature_rows(shop: Shop) -> DataFrame:
    """The feature vectors, unpacked."""
    rows = forecast.with_features(forecast.with_month_number(shop.months))
    unpacked = rows.withColumn("values", vector_to_array("features"))
    return unpacked.selectExpr(
        "order_year", "order_month", "total_orders", "size(values) AS feature_count", "values[0] AS month_feature"
    )


def _raw_rules(shop: Shop) -> DataFrame:
    """The silver rules on uncleaned tables: rows fail, and rules on columns silver adds are errors."""
    return bronze.union_reports(
        [check_rules(df, table, quality.SILVER_RULES[table]) for table, df in shop.raw.items()]
    )


def _required_rules(shop: Shop) -> DataFrame:
    return check_rules(shop.silver["customers"], "customers", quality.REQUIRED_CUSTOMER_RULES)


BUILDERS: dict[str, Callable[[Shop], DataFrame]] = {
    # Sources, layout, SQL
    "io01_raw_customers": lambda s: s.raw["customers"],
    "io01_raw_products": lambda s: s.raw["products"],
    "io01_raw_orders": lambda s: s.raw["orders"],
    "io01_raw_order_items": lambda s: s.raw["order_items"],
    "io01_read_layer": lambda s: tables.read_layer(s.spark, f"{s.directory}/part.parquet"),
    "io09_clustered_orders": lambda s: cluster_table(_comparable(s.silver["orders"]), "silver_orders"),
    "io09_clustered_order_items": lambda s: cluster_table(_comparable(s.silver["order_items"]), "silver_order_items"),
    "io11_bounded_countries": lambda s: insights.top_countries(s.raw["customers"].selectExpr("trim(country) AS country"), 5),
    "io12_sql_age_groups": lambda s: kpis.customers_per_age_group(s.silver["customers"]),
    # Audit
    "au04_record_totals": lambda s: bronze.record_totals(bronze.row_counts(s.silver)),
    "au05_lineage": _lineage,
    # Bronze
    "br01_bronze_orders_full": _bronze_full,
    "br03_bronze_customers": lambda s: _bronze_table(s, "customers"),
    "br03_bronze_products": lambda s: _bronze_table(s, "products"),
    "br03_bronze_orders": lambda s: _bronze_table(s, "orders"),
    "br03_bronze_order_items": lambda s: _bronze_table(s, "order_items"),
    "br04_record_hash": _record_hashes,
    "br05_record_id": lambda s: aggregate(
        s.bronze["orders"],
        [],
        {"records": "COUNT(*)", "ids": "COUNT(bronze_record_id)", "distinct_ids": "COUNT(DISTINCT bronze_record_id)"},
    ),
    "br06_validation": _bronze_validation,
    "br07_row_counts": lambda s: bronze.row_counts(s.bronze),
    "br09_null_counts": lambda s: bronze.union_reports([bronze.null_counts(df, t) for t, df in s.raw.items()]),
    "br10_duplicates": lambda s: bronze.union_reports(
        [bronze.duplicate_count(df, t, [KEYS[t]]) for t, df in s.raw.items()]
    ),
    "br11_source_file": lambda s: bronze.with_source_file(s.raw["products"], "products").drop("ingestion_timestamp"),
    # Silver
    "sc_silver_customers": lambda s: _comparable(s.silver["customers"]),
    "sp_silver_products": lambda s: _comparable(s.silver["products"]),
    "so_silver_orders": lambda s: _comparable(s.silver["orders"]),
    "si_silver_order_items": lambda s: _comparable(s.silver["order_items"]),
    # Quality
    "dq01_silver_rules": lambda s: quality.silver_rule_results(s.silver),
    "dq07_raw_rules": _raw_rules,
    "dq08_quality_scores": lambda s: quality_scores(quality.silver_rule_results(s.silver)),
    "dq09_orders_without_customer": lambda s: quality.orders_without_customer(s.silver["orders"], s.silver["customers"]),
    "dq10_items_without_order": lambda s: quality.items_without_order(s.silver["order_items"], s.silver["orders"]),
    "dq11_items_without_product": lambda s: quality.items_without_product(s.silver["order_items"], s.silver["products"]),
    "dq12_total_mismatches": lambda s: quality.order_total_mismatches(s.silver["orders"], s.silver["order_items"]),
    "dq13_cross_table_checks": lambda s: quality.cross_table_checks(s.silver),
    "dq13_checks_passed": lambda s: quality.checks_passed(quality.cross_table_checks(s.silver)),
    "dq14_gold_assessment": lambda s: quality.gold_assessment(_gold_tables(s)),
    "dq15_raw_checks": lambda s: quality.raw_checks(s.raw),
    "dq16_required_rules": _required_rules,
    "dq18_money_scale": lambda s: quality.money_scale_checks(s.silver),
    "dq17_preview_customers": lambda s: tables.preview(s.silver["customers"], ["customer_id"]),
    # Gold
    "gc01_order_metrics": lambda s: gold.customer_order_metrics(s.silver["orders"]),
    "gc02_product_metrics": lambda s: gold.customer_product_metrics(s.sales, s.silver["products"]),
    "gc04_customer_analytics": lambda s: s.customers,
    "gc12_metadata": lambda s: gold.with_metadata(s.customers).select("customer_id", "analytics_version"),
    "gc13_customer_order_counts": lambda s: gold.customer_order_counts(s.silver["customers"], s.silver["orders"]),
    "gp01_product_sales": lambda s: gold.product_sales(s.sales),
    "gp02_product_figures": lambda s: s.products,
    "gp09_product_analytics": lambda s: s.ranked_products,
    "gp10_metadata": lambda s: _stamps(s.products, ("product_id",), True),
    "gs01_monthly_sales": lambda s: s.months,
    "gs01_monthly_counts": lambda s: gold.monthly_counts(s.silver["orders"]),
    "gs07_category_months": lambda s: gold.category_months(s.sales, s.silver["products"]),
    "gs06_daily_sales": lambda s: s.days,
    "gs07_category_sales": lambda s: s.categories,
    "gs09_metadata": lambda s: _stamps(s.days, ("order_date",), False),
    "gh03_cohort_analysis": lambda s: s.cohorts,
    "gh04_cohort_sizes": lambda s: gold.cohort_sizes(gold.customer_days(s.silver["customers"], s.silver["orders"])),
    "gh06_cohort_by_month": lambda s: s.monthly_cohorts,
    # KPIs
    "gk01_business_kpis": lambda s: kpis.business_kpis_from_standing(s.customer_standing, s.product_standing, s.months),
    "gk01_business_kpis_of_gold": lambda s: kpis.business_kpis(s.customers, s.products, s.months, s.categories),
    "gk02_top_customers": lambda s: kpis.top_customers(s.customers),
    "gk03_top_products": lambda s: kpis.top_products(s.products),
    "gk04_first_months": lambda s: kpis.first_months(s.months),
    "gk05_category_overview": lambda s: kpis.category_overview(s.categories),
    "gk06_age_groups_sql": lambda s: kpis.customers_per_age_group(s.customers),
    "gk07_latest_months_sql": lambda s: kpis.latest_months(s.months),
    # Data behind the charts
    "an01_age_groups": lambda s: insights.value_counts(s.customers, "customer_age_group"),
    "an01_value_segments": lambda s: insights.value_counts(s.customers, "value_segment"),
    "an01_recency_segments": lambda s: insights.value_counts(s.customers, "recency_segment"),
    "an01_sales_performance": lambda s: insights.value_counts(s.products, "sales_performance", "product_count"),
    "an02_top_countries": lambda s: insights.top_countries(s.customers),
    "an03_country_summary": lambda s: insights.country_summary(s.customers),
    "an04_spending_points": lambda s: insights.spending_points(s.customers),
    "an05_revenue_by_category": lambda s: insights.revenue_by_category(s.products),
    "an06_product_points": lambda s: insights.product_points(s.products),
    "an07_best_sellers": lambda s: insights.best_sellers(s.products),
    "an08_category_stats": lambda s: insights.category_stats(s.products),
    "an09_monthly_trend": lambda s: insights.monthly_trend(s.months),
    "an10_daily_revenue": lambda s: insights.daily_revenue(s.days),
    "an11_weekday_performance": lambda s: insights.weekday_performance(s.days),
    "an12_retention_matrix": _retention_matrix,
    "an12_retention_rates": lambda s: insights.retention_rates(s.monthly_cohorts),
    "an13_cohort_start_sizes": lambda s: insights.cohort_sizes_at_start(s.monthly_cohorts),
    "an14_executive_metrics": lambda s: insights.executive_metrics(
        s.customer_standing, gold.product_quantities(s.silver["products"], s.sales), s.months
    ),
    "an15_top_category": lambda s: insights.top_category(s.categories),
    "an16_order_value_histogram": lambda s: insights.order_value_histogram(s.customers),
    "an17_top_age_group": lambda s: insights.top_age_group(s.customers),
    "an18_churn_rate": lambda s: insights.churn_rate(s.customers),
    "an19_top_country": lambda s: insights.top_revenue_country(s.customers),
    "an20_raw_summary": lambda s: insights.raw_summary(s.raw["customers"], s.raw["orders"]),
    # Forecast
    "ml01_month_number": lambda s: forecast.with_month_number(s.months).select(
        "order_year", "order_month", "total_orders", "month_numeric"
    ),
    "ml02_features": _feature_rows,
    "ml03_time_split": lambda s: s.split_months.select("order_year", "order_month", "is_train"),
    "ml04_fitted_line": lambda s: _rounded(forecast.fit_line(s.split_months), "slope", "intercept"),
    "ml04_lines_by_category": lambda s: _rounded(
        forecast.lines_of_sums(forecast.regression_sums(s.split_category_months, ["category"]), ["category"]), "slope", "intercept"
    ),
    "ml04_model_forecast": _model_forecast,
    "ml05_predictions": lambda s: _rounded(
        forecast.predict(s.split_months).select("order_year", "order_month", "total_orders", "prediction", "residual"),
        "prediction", "residual",
    ),
    "ml05_rmse_by_category": lambda s: _rounded(
        forecast.rmse(forecast.predict(s.split_category_months, ["category"]), ["category"]), "rmse"
    ),
    "ml05_rmse": lambda s: _rounded(forecast.rmse(forecast.predict(s.split_months)), "rmse"),
}


def _query(build: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, directory: build(Shop(spark, directory.rstrip("/")))


def all_queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in BUILDERS.items()}
