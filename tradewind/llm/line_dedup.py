"""Removal of boilerplate lines by the number of distinct sites that carry them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import stored

LG_K = 12  # registers of a sketch: 4096, standard error about 1.6 %
BAND = 0.1  # more than six standard errors to each side of the threshold


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def site_spread(lines: DataFrame, threshold: int) -> DataFrame:
    """Of lines (line, site), the line keys that at least ``threshold`` distinct sites carry.

    HyperLogLog sketches of the sites are merged per line, within a task first. Estimates that are clearly above or
    below the threshold decide at once; for the lines in between the distinct sites are counted exactly.
    """
    estimates = stored(
        lines.where(F.col("site").isNotNull())
        .groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= threshold)
        .select("line", "sites")
    )
    margin = max(1.0, BAND * threshold)
    near = estimates.where(F.abs(F.col("sites") - threshold) <= margin).select("line")
    exact = (
        lines.join(near, "line", "left_semi")
        .where(F.col("site").isNotNull())
        .distinct()
        .groupBy("line")
        .count()
        .where(F.col("count") >= threshold)
    )
    return stored(estimates.where(F.col("sites") > threshold + margin).select("line").union(exact.select("line")))


def line_dedup(
    docs: DataFrame, threshold: int = 8, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_removed``, ``kept_text``.

    A line is what stands between line feeds. It goes from every document if at least ``threshold`` distinct sites
    carry exactly this line; lines of white space alone always stay. The kept lines are joined by line feeds.

    A NULL text has one empty line, as the empty text has; a NULL site counts as no site. Rows that share id and text
    get the same result. Extra columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("content"), F.col(site_col).cast("string").alias("site")
    )
    same = F.xxhash64("id", "content")
    exploded = base.select(
        "id", same.alias("row_key"), "site", F.posexplode(lines_of(F.col("content"))).alias("at", "raw")
    ).where(F.col("raw").rlike("[^\\x20\\x09-\\x0D]"))
    # The key of a line, made once and read by each of the steps.
    lines = stored(exploded.select("id", "row_key", "site", "at", F.unhex(F.md5("raw")).alias("line")))
    common = site_spread(lines.select("line", "site"), threshold)
    gone = (
        lines.join(common, "line", "left_semi")
        .groupBy("id", "row_key")
        .agg(F.collect_set("at").alias("gone"))
        .select(F.col("id").alias("gone_id"), F.col("row_key").alias("gone_key"), "gone")
    )
    joined = base.withColumn("row_key", same).join(
        gone.hint("shuffle_hash"),
        F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")),
        "left",
    )
    every = lines_of(F.col("content"))
    places = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return joined.select(
        F.col("id").alias(id_col),
        F.size(every).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.coalesce("content", F.lit("")))
        .otherwise(F.array_join(F.transform(places, lambda i: F.get(every, i)), "\n"))
        .alias("kept_text"),
    )
