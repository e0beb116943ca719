"""Connected components of links, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b: bigint); the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node near it, so that
    even long chains are short after a few rounds. A node with very many links is never gathered: the smallest
    neighbour is an aggregate, and the links follow by a join that Spark may split. Ends when nothing changes.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("c"), F.least("low", "u").alias("m"))
        grown = stored(
            both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = grown.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        edges = stored(
            grown.join(low, F.col("u") == F.col("c"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
