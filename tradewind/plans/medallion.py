"""The whole run: raw to bronze to silver to gold, written, registered, checked and logged.

Every table is computed once and counted by its own write. Later steps read what earlier steps wrote, so
no plan spans more than one layer, and a lost executor costs a task of the current layer only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.config import TABLES, Layout, Thresholds
from tradewind.operators.rules import quality_scores, require, row_metrics, settled_rules
from tradewind.plans import bronze, gold, kpis, quality, reports, silver
from tradewind.plans.audit import ERROR, SUCCESS, Outcome, RunLog, log_step
from tradewind.sources import tables as io

GOLD_TABLES = tuple(quality.GOLD_KEY_COLUMNS)
CLUSTERED_GOLD = (*GOLD_TABLES, "cohort_by_month")
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id"}
BRONZE_COLUMNS = (
    "bronze_ingestion_timestamp", "bronze_ingestion_date", "source_system", "source_table", "data_quality_status",
    "record_hash", "record_md5", "bronze_record_id",
)
REQUIRED = "required_rules"
SALES, FIGURES = "sales_lines", "product_figures"
LINEAGE = "data_lineage_bronze_to_silver"
KPIS = "business_kpis"
MONITORING = "pipeline_monitoring"


@dataclass(frozen=True)
class Settings:
    """What a run needs to know besides the data.

    ``required``: gold is built only if the rules that silver customers must hold do hold. ``clustered``: all silver and
    gold tables are rewritten in clustered order at the end. ``expected_columns``: what each raw table should
    have; by default what it has. ``order_buckets``: silver orders and items are stored in so many buckets by order
    instead of clustered, so that joining and adding them up by order needs no exchange; not for data in which single orders
    hold a large share of the lines, as a bucket is read by one task.
    """

    layout: Layout
    as_of: date
    thresholds: Thresholds = Thresholds()
    survivor_order: Mapping[str, Sequence[str]] | None = None
    fmt: str = "parquet"
    database: str | None = None
    required: bool = False
    clustered: bool = True
    expected_columns: Mapping[str, Sequence[str]] | None = None
    order_buckets: int | None = None

    def buckets_of(self, layer: str, table: str) -> tuple[int, Sequence[str]] | None:
        bucketed = self.order_buckets and layer == "silver" and table in ("orders", "order_items")
        return (self.order_buckets, ("order_id",)) if bucketed else None

    def survivors(self, table: str) -> Sequence[str]:
        return (self.survivor_order or {}).get(table, ())

    def catalog_name(self, name: str) -> str:
        return f"{self.database}.{name}" if self.database else name


@dataclass(frozen=True)
class Report:
    """What a run leaves for the caller: outcomes, and the small result frames of its checks."""

    log: RunLog
    silver_rules: DataFrame | None
    cross_checks: DataFrame | None
    gold_quality: DataFrame | None
    silver_quality: float | None
    healthy: bool
    raw_checks: DataFrame | None = None
    bronze_validation: DataFrame | None = None
    bronze_nulls: DataFrame | None = None
    money_scale: DataFrame | None = None

    @property
    def status(self) -> str:
        return self.log.status()


class Medallion:
    """One run over one layout."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark = spark
        self.settings = settings
        self.log = RunLog(spark, settings.layout.path("gold", MONITORING))
        self.raw_checks: DataFrame | None = None
        self.bronze_validation: DataFrame | None = None
        self.bronze_nulls: DataFrame | None = None
        # What the write of each table counted on its way, by step; None where a rule failed on the data.
        self.counted: dict[str, dict | None] = {}

    # Files ---------------------------------------------------------------------------------

    def read(self, layer: str, table: str) -> DataFrame:
        """Raw tables are read by their path, all others through their catalog entries."""
        if layer == "raw":
            return io.read_layer(self.spark, self.settings.layout.path(layer, table), self.settings.fmt)
        return io.read_table(self.spark, self.settings.catalog_name(f"{layer}_{table}"))

    def _publish(
        self, df: DataFrame, layer: str, table: str, properties: Mapping[str, str] | None = None, metrics: Mapping[str, str] | None = None
    ) -> dict:
        s = self.settings
        name, path = s.catalog_name(f"{layer}_{table}"), s.layout.path(layer, table)
        return io.publish(df, name, path, s.fmt, properties, metrics, s.buckets_of(layer, table))

    # Bronze --------------------------------------------------------------------------------

    def ingest_to_bronze(self, source: str, target: str, table: str) -> int:
        """Add metadata to a raw table and publish it below ``target``; returns the number of rows, errors are logged and raised."""
        step = f"bronze_{table}"

        def work() -> int:
            raw = io.read_layer(self.spark, source, self.settings.fmt)
            name, fmt = self.settings.catalog_name(step), self.settings.fmt
            metrics = bronze.null_metrics(raw.columns)
            self.counted[step] = found = io.publish(bronze.with_metadata(raw, table), name, target, fmt, metrics=metrics)
            return int(found["rows"])

        return self.log.step(step, work, reraise=True).records

    def check_raw(self) -> DataFrame | None:
        """Verdicts on the tables as they arrived, each failed one logged; nothing is held back for them."""
        raw = {t: self.read("raw", t) for t in TABLES}
        return self._noted("Raw checks", self._settled(quality.raw_checks(raw)))

    def _noted(self, name: str, checks: DataFrame) -> DataFrame:
        failed = [f"{r.check_name}: {r.failed_count}" for r in checks.collect() if not r.passed]
        log_step(name, "FAILED CHECKS" if failed else SUCCESS, "; ".join(failed) or None)
        return checks

    def check_bronze(self) -> None:
        """Counts, columns and duplicates of each bronze table, and the NULLs per column that its write counted."""
        stored = self._stored("bronze", TABLES)
        reports, nulls = [], []
        for table, df in stored.items():
            raw = [c for c in df.columns if c not in BRONZE_COLUMNS]
            expected = (self.settings.expected_columns or {}).get(table, raw)
            reports.append(bronze.validation_report(df, table, [*expected, *BRONZE_COLUMNS], [KEYS[table]]))
            nulls += bronze.nulls_of_counts(table, raw, self.counted[f"bronze_{table}"])
        if not reports:
            return
        self.bronze_validation = self._settled(bronze.union_reports(reports))
        self.bronze_nulls = io.rows_to_frame(self.spark, nulls, "table_name string, column_name string, null_count bigint")
        for r in self.bronze_validation.collect():
            odd = [f"missing {', '.join(r.missing_columns)}"] if r.missing_columns else []
            odd += [f"unexpected {', '.join(r.extra_columns)}"] if r.extra_columns else []
            odd += [f"{r.duplicate_count} repeated keys"] if r.duplicate_count else []
            log_step(f"Validate bronze_{r.table_name}", "FAILED CHECKS" if odd else SUCCESS, "; ".join(odd) or None)

    def run_bronze(self) -> None:
        layout = self.settings.layout
        self.raw_checks = self._try("Raw checks", self.check_raw)
        for table in TABLES:
            self.ingest_to_bronze(layout.path("raw", table), layout.path("bronze", table), table)
        self._try("Bronze validation", self.check_bronze)

    def _try(self, name: str, check: Callable[[], DataFrame | None]) -> DataFrame | None:
        """A check of what arrived: that it can't be made is logged, and the steps that need the table will say so too."""
        try:
            return check()
        except PySparkException as error:
            log_step(name, ERROR, str(error).splitlines()[0])
            return None

    # Silver --------------------------------------------------------------------------------

    def clean(self, table: str) -> DataFrame:
        s, df = self.settings, self.read("bronze", table)
        order = s.survivors(table)
        if table == "customers":
            return silver.clean_customers(df, s.as_of, order)
        if table == "products":
            return silver.clean_products(df, order)
        if table == "orders":
            return silver.clean_orders(df, s.as_of, s.thresholds, order)
        return silver.clean_order_items(df, s.thresholds, order)

    def store_silver(self, table: str) -> int:
        """Clean and publish a table; its write counts the rows that break rules, and amounts off scale.

        A rule may also fail on the data (a cast, say), and the write with it: then the table is written without them, and
        the rules are checked one by one on what is stored.
        """
        step, df = f"silver_{table}", self.clean(table)
        metrics = {**row_metrics(df, quality.SILVER_RULES[table]), **quality.money_metrics(table)}
        if table == "customers":
            metrics |= row_metrics(df, quality.REQUIRED_CUSTOMER_RULES, "required")
        try:
            self.counted[step] = found = self._publish(df, "silver", table, io.silver_properties(table), metrics)
        except PySparkException as error:
            log_step(f"Rules on the way of {step}", ERROR, str(error).splitlines()[0])
            self.counted[step], found = None, self._publish(df, "silver", table, io.silver_properties(table))
        return int(found["rows"])

    def run_silver(self) -> None:
        for table in TABLES:
            self.log.step(f"silver_{table}", lambda t=table: self.store_silver(t), [f"bronze_{table}"])

    def _stored(self, layer: str, names: Sequence[str]) -> dict[str, DataFrame]:
        return {t: self.read(layer, t) for t in names if self.log.succeeded([f"{layer}_{t}"])}

    def check_silver(self) -> DataFrame | None:
        """Verdicts of the silver rules, a handful of rows each; uniqueness alone reads the stored tables."""
        stored = self._stored("silver", TABLES)
        if not stored:
            return None
        return bronze.union_reports(
            [settled_rules(df, t, quality.SILVER_RULES[t], self.counted[f"silver_{t}"]) for t, df in stored.items()]
        )

    def check_references(self) -> DataFrame | None:
        """Cross-table verdicts, run once: the four rows are kept, not the plan."""
        stored = self._stored("silver", TABLES)
        return self._settled(quality.cross_table_checks(stored)) if len(stored) == len(TABLES) else None

    def check_required(self) -> None:
        """The step that gold waits for if the settings ask for it; fails with the rules that do not hold."""

        def work() -> int:
            customers, counts = self.read("silver", "customers"), self.counted["silver_customers"]
            require(settled_rules(customers, "customers", quality.REQUIRED_CUSTOMER_RULES, counts, "required"))
            return 0

        self.log.step(REQUIRED, work, ["silver_customers"])

    def check_money(self) -> DataFrame | None:
        """Amounts with more decimals than the sums of money keep, per column, as the writes counted them; each is logged."""
        if not self.log.succeeded([f"silver_{t}" for t in quality.MONEY_COLUMNS]):
            return None
        counts = {t: self.counted[f"silver_{t}"] for t in quality.MONEY_COLUMNS}
        if None in counts.values():
            return self._noted("Money scale", self._settled(quality.money_scale_checks(self._stored("silver", tuple(counts)))))
        return self._noted("Money scale", quality.money_scale_of_counts(self.spark, counts))

    def _settled(self, small: DataFrame, limit: int = 100) -> DataFrame:
        return self.spark.createDataFrame(io.to_driver(small, limit), small.schema)

    def _counts(self, layer: str) -> DataFrame:
        """Rows per table as counted by the writes; no table is read again."""
        rows = [(t, self.log.outcomes[f"{layer}_{t}"].records) for t in TABLES if self.log.succeeded([f"{layer}_{t}"])]
        return io.rows_to_frame(self.spark, rows, "table_name string, record_count bigint")

    def write_lineage(self, scores: DataFrame) -> Outcome:
        path = self.settings.layout.path("gold", LINEAGE)

        def work() -> int:
            rows = quality.lineage_from_counts(self._counts("bronze"), self._counts("silver"), scores)
            io.append(rows, path, self.settings.fmt)
            io.register(self.spark, self.settings.catalog_name(LINEAGE), path, self.settings.fmt)
            return 0

        return self.log.step(LINEAGE, work)

    # Gold ----------------------------------------------------------------------------------

    def _gold_plans(self) -> dict[str, tuple[Callable[[], DataFrame], Sequence[str], bool]]:
        """Per gold table: its plan, the steps it needs, and whether it carries last_updated."""
        s = self.settings

        def cleaned(table: str) -> DataFrame:
            return self.read("silver", table)

        def sales() -> DataFrame:
            return self.read("gold", SALES)

        return {
            "customer_analytics": (
                lambda: gold.customer_analytics(
                    cleaned("customers"), cleaned("orders"), sales(), cleaned("products"), s.as_of, s.thresholds
                ),
                ("silver_customers", "silver_orders", "silver_products", SALES),
                True,
            ),
            "product_analytics": (
                lambda: gold.with_revenue_rank(self.read("gold", FIGURES)),
                (FIGURES,),
                True,
            ),
            "monthly_sales": (lambda: gold.monthly_sales(cleaned("orders")), ("silver_orders",), False),
            "daily_sales": (lambda: gold.daily_sales(cleaned("orders")), ("silver_orders",), False),
            "category_sales": (
                lambda: gold.category_sales(sales(), cleaned("products")),
                ("silver_products", SALES),
                False,
            ),
            "cohort_analysis": (
                lambda: gold.cohort_analysis(cleaned("customers"), cleaned("orders")),
                ("silver_customers", "silver_orders"),
                False,
            ),
            "cohort_by_month": (
                lambda: gold.cohort_by_month(cleaned("customers"), cleaned("orders")),
                ("silver_customers", "silver_orders"),
                False,
            ),
        }

    def run_gold(self) -> None:
        """Join orders and lines once, store that, and build the item reports from it."""
        first = [REQUIRED] if self.settings.required else []
        s = self.settings

        def stored(df: DataFrame, table: str, properties: Mapping[str, str] | None = None) -> int:
            metrics = {"null_issues": quality.null_issues(df.columns, table)} if table in GOLD_TABLES else {}
            self.counted[f"gold_{table}"] = found = self._publish(df, "gold", table, properties, metrics)
            return int(found["rows"])

        self.log.step(
            SALES,
            lambda: stored(gold.sales_lines(self.read("silver", "orders"), self.read("silver", "order_items")), SALES),
            ("silver_orders", "silver_order_items", *first),
        )
        self.log.step(
            FIGURES,
            lambda: stored(gold.product_figures(self.read("silver", "products"), self.read("gold", SALES), s.as_of, s.thresholds), FIGURES),
            ("silver_products", SALES),
        )
        for table, (plan, needs, updated) in self._gold_plans().items():
            self.log.step(
                f"gold_{table}",
                lambda p=plan, t=table, u=updated: stored(gold.with_metadata(p(), updated=u), t, io.gold_properties(t)),
                [*needs, *first],
            )

    def write_kpis(self) -> Outcome:
        path = self.settings.layout.path("gold", KPIS)
        sources = ("customer_analytics", "product_analytics", "monthly_sales", "category_sales")

        def work() -> int:
            rows = kpis.stamped_kpis(kpis.business_kpis(*[self.read("gold", t) for t in sources]))
            io.append(rows, path, self.settings.fmt)
            io.register(self.spark, self.settings.catalog_name(f"gold_{KPIS}"), path, self.settings.fmt)
            return 0

        return self.log.step(f"gold_{KPIS}", work, [f"gold_{t}" for t in sources])

    def check_gold(self) -> DataFrame | None:
        """Grades of the gold tables by the NULLs that their writes counted; no table is read."""
        done = [t for t in GOLD_TABLES if self.log.succeeded([f"gold_{t}"])]
        counts = {t: (int(found["rows"]), int(found["null_issues"] or 0)) for t in done if (found := self.counted[f"gold_{t}"])}
        return quality.assessment_of_counts(self.spark, counts) if counts else None

    # Upkeep --------------------------------------------------------------------------------

    def compact(self, layer: str, table: str, files: int | None = None) -> str:
        """Publish a stored table anew in clustered order; returns where it is."""
        name = f"{layer}_{table}"
        if not self.log.succeeded([name]):
            raise ValueError(f"{name} was not written by this run")
        current = self.settings.layout.path(layer, table)
        return io.rewrite_clustered(self.spark, self.settings.catalog_name(name), current, self.settings.fmt, files, name)

    def compact_all(self) -> None:
        """Cluster every silver and gold table that this run wrote and that isn't stored in buckets."""
        for layer, names in (("silver", TABLES), ("gold", CLUSTERED_GOLD)):
            for table in names:
                if self.log.succeeded([f"{layer}_{table}"]) and not self.settings.buckets_of(layer, table):
                    self.log.step(f"compact_{layer}_{table}", lambda a=layer, b=table: self.compact(a, b) and 0)

    def reports(self) -> dict[str, Callable[[], DataFrame]]:
        """The reports over the stored gold tables, by name; each reads its tables when it is called."""
        return reports.from_gold(lambda table: self.read("gold", table))

    # All -----------------------------------------------------------------------------------

    def run(self) -> Report:
        self.run_bronze()
        self.run_silver()
        rules = self.check_silver()
        scores = None if rules is None else quality_scores(rules)
        average = None if scores is None else scores.agg(F.avg("quality_score")).first()[0]
        if scores is not None:
            self.write_lineage(scores)
        references = self.check_references()
        money = self.check_money()
        if self.settings.required:
            self.check_required()
        self.log.summarize("Silver layer complete", "silver_", f"average quality {average}")
        self.run_gold()
        self.write_kpis()
        assessed = self.check_gold()
        gold_average = None if assessed is None else assessed.agg(F.avg("quality_score")).first()[0]
        self.log.summarize("Gold layer complete", "gold_", f"average quality {gold_average}")
        if self.settings.clustered:
            self.compact_all()
        limits = self.settings.thresholds
        healthy = (average or 0) >= limits.healthy_silver and (gold_average or 0) >= limits.healthy_gold
        checks = (self.raw_checks, self.bronze_validation, self.bronze_nulls, money)
        return Report(self.log, rules, references, assessed, average, healthy, *checks)


def run(spark: SparkSession, settings: Settings) -> Report:
    return Medallion(spark, settings).run()
