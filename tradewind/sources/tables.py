"""Tables as directories and as catalog entries.

A table of a layer is an external catalog entry. Publishing writes a complete new version to a folder of its own and
then points the entry there, all with Spark's own SQL: ``spark.table`` and a plain read of the entry's location see
the version in force, and a job that fails leaves the one before. The format is a parameter everywhere; Parquet is the
default because every Spark has it.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.layout import CLUSTER_COLUMNS, cluster_table

log = logging.getLogger(__name__)

METADATA_PREFIXES = ("silver_", "bronze_")
VERSIONS = 3  # folders that the versions of a table take in turn


def read_layer(
    spark: SparkSession, path: str, fmt: str = "parquet", merge_schema: bool = False, schema: str | None = None
) -> DataFrame:
    """Table at a path; ``merge_schema`` unites the columns of files written with different ones.

    A ``schema`` that is known beforehand spares the look into the files that finds it.
    """
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    return reader.load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _inside(path: str, other: str) -> bool:
    """Whether one of the two directories contains the other."""
    one, two = (p.split(":", 1)[-1].rstrip("/") + "/" for p in (path, other))
    return one.startswith(two) or two.startswith(one)


def _observed(df: DataFrame, metrics: Mapping[str, str] | None) -> tuple[DataFrame, Observation]:
    """``df`` with a row count and further aggregates that are taken while it is written."""
    seen = Observation()
    more = [F.expr(sql).alias(name) for name, sql in (metrics or {}).items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", sources: Sequence[str] = ()) -> int:
    """Replace the files at ``path``, schema included, and return the number of rows written.

    This is Spark's own overwrite, for folders without a catalog entry: the old files go before the new ones are complete, so a job
    that fails loses them; ``publish`` doesn't. ``sources`` are the paths the plan reads; a table is not to be replaced by
    what is read from it. The rows are counted by the write itself: the plan runs once.
    """
    for source in sources:
        if _inside(path, source):
            raise ValueError(f"{path} is read by the plan that would overwrite it; publish a new version instead")
    df, seen = _observed(df, None)
    df.write.format(fmt).mode("overwrite").save(path)
    return int(seen.get.get("rows", 0))


def _details(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog says about an entry, by its headings (Location, Num Buckets, ...)."""
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}


def location(spark: SparkSession, name: str) -> str | None:
    """The folder of the version in force; None without an entry."""
    return _details(spark, name)["Location"] if spark.catalog.tableExists(name) else None


def _columns(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def _create(spark: SparkSession, name: str, schema: StructType, fmt: str, place: str, buckets: tuple[int, Sequence[str]] | None) -> None:
    columns = ", ".join(f"`{column}` {kind}" for column, kind in _columns(schema))
    grouped = ""
    if buckets:
        keys = ", ".join(f"`{c}`" for c in buckets[1])
        grouped = f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets[0]} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING {fmt}{grouped} LOCATION {_quoted(place)}")


def publish(
    df: DataFrame,
    name: str,
    path: str,
    fmt: str = "parquet",
    properties: Mapping[str, str] | None = None,
    metrics: Mapping[str, str] | None = None,
    buckets: tuple[int, Sequence[str]] | None = None,
    versions: int = VERSIONS,
) -> dict:
    """Replace table ``name``, schema included, by a version below ``path``; returns its ``rows`` and ``metrics`` (name -> count).

    The versions take the folders ``path/v0``, ``path/v1``, ... in turn. The rows are written to the next one, which is not the one in
    force, through an entry of their own; then the entry is pointed there in one statement, or, if columns or buckets
    changed, made anew with its properties. The plan may read the table that it replaces. Readers of a
    version are undisturbed until its folder's turn comes again, ``versions - 1`` publications later. One writer a table at a time.
    ``buckets`` (number, columns): files are dealt and sorted by these columns, so that joins and groupings by them need no exchange.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before = location(spark, name)
    turn = before.rpartition("/v")[2] if before else ""
    place = f"{path}/v{(int(turn) + 1) % versions if turn.isdigit() else 0}"
    staged = f"{name}__next"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    _create(spark, staged, df.schema, fmt, place, buckets)
    try:
        watched, seen = _observed(df, metrics)
        watched.write.insertInto(staged, overwrite=True)
        _point(spark, name, df.schema, fmt, place, buckets, properties)
    finally:
        spark.sql(f"DROP TABLE {staged}")  # external: the files stay
    return {"rows": 0, **dict.fromkeys(metrics or {}, 0), **seen.get}  # an empty plan may be written without being observed


def _point(
    spark: SparkSession, name: str, schema: StructType, fmt: str, place: str, buckets: tuple[int, Sequence[str]] | None, properties: Mapping[str, str] | None
) -> None:
    """An entry for these files; one that has other columns or buckets is made anew, its properties included.

    An entry keeps the columns it was made with, and would hide the others.
    """
    kept: dict[str, str] = {}
    exists = spark.catalog.tableExists(name)
    if exists:
        details = _details(spark, name)
        dealt = (details.get("Num Buckets"), details.get("Bucket Columns"))
        wanted = (str(buckets[0]), str([f"`{c}`" for c in buckets[1]]).replace("'", "")) if buckets else (None, None)
        if _columns(spark.table(name).schema) != _columns(schema) or dealt != wanted:
            kept = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
            kept = {k: v for k, v in kept.items() if not k.startswith(("spark.", "transient_"))}
            spark.sql(f"DROP TABLE {name}")  # external: the files stay
            exists = False
    if exists:
        spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(place)}")
    else:
        _create(spark, name, schema, fmt, place, buckets)
    if stamped := {**kept, **(properties or {})}:
        pairs = ", ".join(f"{_quoted(key)} = {_quoted(value)}" for key, value in stamped.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")
    spark.catalog.refreshTable(name)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to an audit table."""
    df.write.format(fmt).mode("append").save(path)


def rows_to_frame(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A typed frame from a few driver rows (audit entries); data never takes this way."""
    return spark.createDataFrame(list(rows), schema)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", properties: Mapping[str, str] | None = None
) -> None:
    """External catalog entry over the files at a path; an existing entry is pointed there and refreshed."""
    _point(spark, name, spark.read.format(fmt).load(path).schema, fmt, path, None, properties)


def silver_properties(table: str) -> dict[str, str]:
    return {
        "description": f"Silver layer cleaned and enriched {table}",
        "layer": "silver",
        "data_quality_validated": "true",
    }


def gold_properties(table: str) -> dict[str, str]:
    return {
        "description": f"Gold layer business analytics for {table}",
        "layer": "gold",
        "business_ready": "true",
        "analytics_version": "1.0",
    }


def rewrite_clustered(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    files: int | None = None,
    layout_of: str | None = None,
) -> str:
    """Publish a table anew in clustered order. ``layout_of`` names the layout where the catalog name is qualified.

    Readers of the old version go on undisturbed, and a failed rewrite leaves the table as it was. Returns the new location.
    """
    layout = layout_of or name
    if layout not in CLUSTER_COLUMNS:
        raise ValueError(f"no cluster columns are defined for {layout}")
    source = read_table(spark, name)
    clustered = cluster_table(source, layout, files)
    if clustered.columns != source.columns:
        raise ValueError(f"the clustered copy of {name} would have other columns than its source")
    publish(clustered, name, path, fmt)
    return location(spark, name)


def preview(df: DataFrame, order_by: Sequence[str], columns: int = 10, rows: int = 3) -> DataFrame:
    """First business columns of the first rows, for a look at a table."""
    business = [c for c in df.columns if not c.startswith(METADATA_PREFIXES)]
    return df.orderBy(*order_by).select(*business[:columns]).limit(rows)


def to_driver(df: DataFrame, limit: int) -> list[Row]:
    """At most ``limit`` rows on the driver; asks for one more and refuses to cut silently."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"result has more than {limit} rows; aggregate it before collecting")
    return rows
