"""A Spark session with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # One calendar for every date expression, whatever the driver's machine says.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Shuffle sizes, join kinds and skewed join partitions are settled at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "tradewind", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above.

    ``extra`` takes further settings with ``__`` for the dots, for example
    ``spark__sql__shuffle__partitions="8"``. On a cluster, leave the number of shuffle
    partitions to the deployment: it follows the data, not this code.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
