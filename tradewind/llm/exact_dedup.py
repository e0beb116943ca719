"""Exact deduplication by progressive refinement: length, then prefix hash, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.store import may_contain, membership, stored

BITS = 1 << 23  # a membership bitmap of 1 MB


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL counts as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, hash_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``content_hash``.

    Rows are grouped by the length of the normalised text; lengths that occur once are done. What is left is grouped
    by length and the hash of the first ``prefix`` characters, and only rows that share both with another row have
    their whole text hashed (SHA-256) and grouped by it. Between the steps only keys are shuffled, never texts: the
    surviving keys go into a bitmap of bounded size, which spares the other rows the next hash; the exact grouping
    follows. ``hash_all`` computes ``content_hash`` for the other rows too, where it is NULL otherwise.

    NULL texts equal empty ones. A NULL id is the last choice to stay. Of rows with the same id and text one stays.
    Extra columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content"))
    head = F.xxhash64(F.substring("content", 1, prefix))
    keys = stored(base.select(F.octet_length("content").cast("long").alias("length"), head.alias("head")))

    shared_lengths = keys.groupBy("length").count().where("count > 1")
    lengths = membership(shared_lengths, F.xxhash64("length"), BITS)
    same_length = may_contain(keys, F.xxhash64("length"), lengths, BITS, "near").where("near")
    shared_heads = same_length.groupBy("length", "head").count().where("count > 1")
    heads = stored(membership(shared_heads, F.xxhash64("length", "head"), BITS))

    wide = base.select("id", "content", F.octet_length("content").cast("long").alias("length"), head.alias("head"))
    wide = may_contain(wide, F.xxhash64("length", "head"), heads, BITS, "near")
    content_hash = F.sha2("content", 256)
    hashed = stored(
        wide.select(
            "id", "length", "head", F.when(F.lit(hash_all) | F.col("near"), content_hash).alias("content_hash"), "near"
        )
    )
    groups = stored(
        hashed.where("near")
        .groupBy("length", "head", "content_hash")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep_id"))
        .where("group_size > 1")
    )
    copies = Window.partitionBy("id", "content_hash").orderBy(F.lit(1))
    return (
        hashed.withColumn("copy", F.when(F.col("near"), F.row_number().over(copies)).otherwise(1))
        .join(groups, ["length", "head", "content_hash"], "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
            "content_hash",
        )
    )
