"""Mixing sources to target weights: fixed-length blocks, multinomial draws per shard, pseudorandom permutations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches, running, stored
from tradewind.llm.words import SPACE, documents, mix

PIECE = 1 << 14  # slots that one row is unfolded into at once
SLOTS_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Weights are dealt to the sources in their order, again and again; ``budget`` and ``cap`` are shares of sizes."""

    weights: tuple[float, ...] = (5, 2, 1)
    budget: float = 1.5
    cap: float = 2.0
    block: int = 128
    shards: int = 32
    seed: int = 7


def targets(sizes: list[int], s: Settings) -> list[float]:
    """Each source's share of the budget by weight; what exceeds a cap is shared again among the others."""
    weights = [float(s.weights[i % len(s.weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), s.budget * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > s.cap * sizes[i]]
        for i in full or open_:
            out[i] = s.cap * sizes[i] if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def slots_of(size: int, target: float, block: int) -> int:
    """Blocks to draw from a source: whole rounds through it, and the rest to the nearest block."""
    if not size:
        return 0
    n = -(-size // block)
    rounds = int(target // size)
    return rounds * n + min(n, round((target - rounds * size) / block))


def draws(slots: list[int], s: Settings) -> np.ndarray:
    """Blocks per (shard, source): a multinomial draw for each shard, then moved between sources until their sums are ``slots``."""
    n = np.array(slots, np.int64)
    total = int(n.sum())
    out = np.zeros((s.shards, len(n)), np.int64)
    if not total:
        return out
    for k in range(s.shards):
        rng = np.random.Generator(np.random.PCG64([s.seed, k]))
        out[k] = rng.multinomial(total // s.shards + (k < total % s.shards), n / total)
    over, k = out.sum(axis=0) - n, 0
    while over.any():
        # Of this shard's blocks, those of sources that have too many give way to sources that have too few.
        give = np.minimum(np.minimum(np.maximum(over, 0), out[k]), np.maximum(1, over // s.shards))
        take = np.maximum(-over, 0)
        moved = min(give.sum(), take.sum())
        give, take = (np.clip(moved - (np.cumsum(x) - x), 0, x) for x in (give, take))
        out[k] += take - give
        over += take - give
        k = (k + 1) % s.shards
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index in a pseudorandom permutation of 0 to size - 1: a Feistel cipher, repeated while it leaves the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.int64)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for r in range(4):
            word = mix(key[todo] + mix((right << np.uint64(3)) + np.uint64(r + 1)))
            left, right = right, left ^ (word & low[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def source_key(source: Column) -> Column:
    """A join key that a NULL source has too."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, row_key, source, size) of each row; the size counts words."""

    def count(batches):
        for batch, data, offsets, i, j in documents(batches):
            space = SPACE[data]
            begins = ~space
            begins[1:] &= space[:-1]
            borders = offsets[:-1][offsets[:-1] < len(data)]
            begins[borders] = ~space[borders]
            sums = np.concatenate([[0], np.cumsum(begins)])
            own = [batch.column(c).slice(i, j - i) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())], ["id", "row_key", "source", "size"])

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("content"))
    base = base.select("id", F.xxhash64("id", "content").alias("row_key"), "source", "content")
    return base.mapInArrow(count, f"id {base.schema['id'].dataType.simpleString()}, row_key bigint, source string, size bigint")


@dataclass
class Mix:
    """``laid``: each document's place in its source's stream of words. ``sources``: size and target of each. ``slots``:
    (shard, slot, source_key, block, round), the blocks of the mix in order."""

    laid: DataFrame
    sources: DataFrame
    slots: DataFrame
    settings: Settings

    def pieces(self) -> DataFrame:
        """(source_key, start, block, low, high): the words of each document in each block of its source."""
        b = self.settings.block
        end = F.col("start") + F.col("size")
        blocks = F.sequence((F.col("start") / b).cast("long"), ((end - 1) / b).cast("long"))
        at = self.laid.where("size > 0").select("id", "row_key", "source_key", "start", "size", F.explode(blocks).alias("block"))
        return at.select(
            "id",
            "row_key",
            "source_key",
            "start",
            "size",
            "block",
            (F.greatest("start", F.col("block") * b) - F.col("start")).alias("low"),
            (F.least(end, (F.col("block") + 1) * b) - F.col("start")).alias("high"),
        )

    def taken(self) -> DataFrame:
        """(id, row_key, size, source_size, target, taken) of each row: how many of its words the mix takes, repeats counted."""
        times = self.slots.groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("times"))
        sums = (
            self.pieces()
            .join(times.hint("merge"), ["source_key", "block"])  # Spark would take the unfolded slots for a small table
            .groupBy("source_key", "start")
            .agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
        )
        sums = sums.select(F.col("source_key").alias("k"), F.col("start").alias("s"), "taken")
        # Documents without words share their start with the next one and take nothing.
        own = (F.col("source_key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("size") > 0)
        out = self.laid.join(sums, own, "left").drop("k", "s").join(self.sources, "source_key")
        return out.select("id", "row_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def spans(self) -> DataFrame:
        """(id, row_key, round, spans): the word spans of a document that each round through its source takes."""
        return (
            self.pieces()
            .join(self.slots.select("source_key", "block", "round").hint("merge"), ["source_key", "block"])
            .groupBy("id", "row_key", "round")
            .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
        )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: Settings | None = None
) -> Mix:
    """The mix of ``docs`` in which each source has its target of words.

    The words of a source, its documents one after the other by id, are packed into blocks of fixed length. Each
    output shard draws how many blocks it takes of each source; the draws are multinomial, then moved so that the
    sums over all shards are what the targets ask for. The slots of a source are numbered through all shards; the slot
    number leads, through a pseudorandom permutation of the source's blocks, one for each round, to the block. A block
    comes once a round, so no document exceeds its source's cap. What passes through the driver are one row per
    source and one per source and shard: sources are collections, some ten thousand at most, not sites or pages.

    NULL texts have no words; NULL is the last source; sources without words have the target 0. Rows that repeat id
    and text are documents of their own. Extra columns are ignored; an empty table gives an empty mix.
    """
    s = settings or Settings()
    sized = sizes_of(docs, id_col, text_col, source_col).withColumn("source_key", source_key(F.col("source")))
    laid = stored(running(sized, ["source_key"], ["id", "row_key"], {"start": "size"}))
    found = laid.groupBy("source_key", "source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["n"] for r in found]
    goals = targets(sizes, s)
    counts = draws([slots_of(n, t, s.block) for n, t in zip(sizes, goals, strict=True)], s)
    spark = docs.sparkSession
    rows = [(r["source_key"], n, t) for r, n, t in zip(found, sizes, goals, strict=True)]
    sources = spark.createDataFrame(rows, "source_key string, source_size bigint, target double")
    first = np.cumsum(counts, axis=0) - counts
    begin = np.cumsum(counts, axis=1) - counts
    plan = [
        (k, r["source_key"], i, -(-sizes[i] // s.block), int(first[k, i]), int(begin[k, i]), int(counts[k, i]))
        for k in range(s.shards)
        for i, r in enumerate(found)
        if counts[k, i]
    ]

    def place(batches):
        for b in batches:
            number = b.column("number").to_numpy()
            size = b.column("blocks").to_numpy()
            rounds = number // size
            seeds = mix(b.column("source_number").to_numpy().astype(np.uint64) * np.uint64(1 << 20) + rounds.astype(np.uint64) + np.uint64(s.seed << 40))
            out = [b.column(c) for c in ("shard", "slot", "source_key")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(permuted(number % size, size, seeds)), pa.array(rounds)], ["shard", "slot", "source_key", "block", "round"])

    # A fixed number of tasks: the rows of the plan are few and small, but what they unfold into isn't.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // SLOTS_PER_TASK)
    planned = spark.createDataFrame(plan, "shard int, source_key string, source_number bigint, blocks bigint, first bigint, begin bigint, n bigint")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / PIECE).cast("long")))
    unfolded = (
        planned.withColumn("piece", piece)
        .repartition(tasks, "shard", "source_key", "piece")
        .withColumn("i", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1)))
    )
    slots = unfolded.select(
        "shard", "source_key", "source_number", "blocks", (F.col("first") + F.col("i")).alias("number"), (F.col("begin") + F.col("i")).alias("slot")
    ).mapInArrow(place, "shard int, slot bigint, source_key string, block bigint, round bigint")
    return Mix(laid, sources, slots, s)


def words_in_spans(text: str | None, spans) -> str | None:
    """The words of the spans joined by spaces; the text as it is if they cover it all."""
    parts = (text or "").encode().split()
    if sum(p["high"] - p["low"] for p in spans) == len(parts):
        return text
    return b" ".join(w for p in spans for w in parts[p["low"] : p["high"]]).decode()


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: Settings | None = None
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document once for each round that takes words of it, with these words.

    Ids are expected to be unique: rows that repeat id and text each get the words that the mix takes of all of them, which
    is more than the mix takes. NULL texts and empty tables give no rows; very long texts are cut like others, and extra columns kept.
    """
    spans = mix_sources(docs, id_col, text_col, source_col, settings).spans()
    spans = spans.select(F.col("id").alias("id_of_mix"), F.col("row_key").alias("key_of_mix"), F.col("spans").alias("spans_of_mix"))
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    joined = docs.join(
        spans.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("id_of_mix")) & (key == F.col("key_of_mix"))
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([words_in_spans(t, p) for t, p in zip(text, spans, strict=True)], dtype=object)

    return joined.withColumn(text_col, cut(F.col(text_col), F.col("spans_of_mix"))).select(*docs.columns)
