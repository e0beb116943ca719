"""Hard negatives of anchors: exact integer inner products tile by tile, and heaps of the best that merge."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.store import stored

LEAF = 32  # a product whose shortest side is no longer is computed directly
ANCHORS, CANDIDATES = 512, 1024  # rows and columns of the score tiles
BLOCK_BYTES = 16 << 20  # anchors and their heaps that go to the tasks at once
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit integers by seven products of halves instead of eight, as long as the sides stay above ``leaf``.

    Sides are filled up with zeros to multiples of the power of two that the recursion divides by. Additions are exact
    modulo 2**64, so every entry that fits 64 bits is exact whatever the sums on the way.
    """
    (m, k), n = a.shape, b.shape[1]
    levels = 0
    while min(m, k, n) > leaf << levels:
        levels += 1
    padded = [-(-x >> levels) << levels if levels else x for x in (m, k, n)]
    full_a, full_b = np.zeros(padded[:2], np.int64), np.zeros(padded[1:], np.int64)
    full_a[:m, :k], full_b[:k, :n] = a, b

    def product(a, b, level):
        if not level:
            return np.einsum("ij,jk->ik", a, b)
        i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
        a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
        b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
        p1 = product(a11 + a22, b11 + b22, level - 1)
        p2 = product(a21 + a22, b11, level - 1)
        p3 = product(a11, b12 - b22, level - 1)
        p4 = product(a22, b21 - b11, level - 1)
        p5 = product(a11 + a12, b22, level - 1)
        p6 = product(a21 - a11, b11 + b12, level - 1)
        p7 = product(a12 - a22, b21 + b22, level - 1)
        out = np.empty((a.shape[0], b.shape[1]), np.int64)
        out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
        out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
        return out

    return product(full_a, full_b, levels)[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` heaps: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.full((n, k), MOST)
        self.count = np.zeros(n, np.int64)

    def floor(self, heaps: np.ndarray | slice) -> np.ndarray:
        """Scores below this can't enter."""
        return np.where(self.count[heaps] == self.k, self.score[heaps, -1], LEAST)

    def push(self, heap: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        enters = (self.count[heap] < self.k) | (score > self.score[heap, -1]) | ((score == self.score[heap, -1]) & (ident < self.id[heap, -1]))
        heap, score, ident = heap[enters], score[enters], ident[enters]
        if not len(heap):
            return
        old = np.unique(heap)
        held = np.arange(self.k) < self.count[old, None]
        heap = np.concatenate([heap, np.repeat(old, self.count[old])])
        score, ident = np.concatenate([score, self.score[old][held]]), np.concatenate([ident, self.id[old][held]])
        order = np.lexsort((ident, ~score, heap))
        heap, score, ident = heap[order], score[order], ident[order]
        rank = np.arange(len(heap)) - np.searchsorted(heap, heap)
        best = rank < self.k
        heap, rank = heap[best], rank[best]
        self.score[heap, rank], self.id[heap, rank] = score[best], ident[best]
        self.count[old] = np.bincount(heap, minlength=len(self.count))[old]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heap = np.repeat(np.arange(len(self.count)), self.count)
        held = np.arange(self.k) < self.count[:, None]
        return heap, self.score[held], self.id[held]


def matrix(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors' first ``width`` components, one row each; missing components are zero."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    at = np.asarray(vectors.offsets)
    values = np.floor(np.asarray(vectors.values)[at[0] : at[-1]] * scale).astype(np.int64)
    size = np.diff(at)
    row, column = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)
    out, within = np.zeros((len(size), width), np.int64), column < width
    out[row[within], column[within]] = values[within]
    return out


@dataclass
class Anchors:
    """One block of anchors, ordered by label."""

    id: np.ndarray
    label: np.ndarray
    rows: np.ndarray

    def tiles(self, first: int = 0, last: int | None = None) -> Iterator[slice]:
        last = len(self.id) if last is None else last
        for i in range(first, last, ANCHORS):
            yield slice(i, min(i + ANCHORS, last))


def candidate_tiles(batches, width: int, scale: int):
    for batch in batches:
        for i in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(i, CANDIDATES)
            ident, label = (np.asarray(part.column(c).cast(pa.int64())) for c in (0, 1))
            yield ident, label, matrix(part.column(2), width, scale)


def nearest_of_label(anchors: Anchors, k: int, scale: int):
    """A task: the ``k`` best rows with the label of each anchor, other than itself."""

    def run(batches):
        a, heaps = anchors.value, Heaps(len(anchors.value.id), k)
        for ident, label, rows in candidate_tiles(batches, a.rows.shape[1], scale):
            for value in np.intersect1d(label, a.label):
                own = np.flatnonzero(label == value)
                for tile in a.tiles(*np.searchsorted(a.label, [value, value + 1] if value < MOST else [value, MOST])):
                    scores = strassen(a.rows[tile], rows[own].T)
                    i, j = np.nonzero(scores >= heaps.floor(tile)[:, None])
                    other = a.id[tile][i] != ident[own][j]
                    i, j = i[other], j[other]
                    heaps.push(i + tile.start, scores[i, j], ident[own][j])
        heap, score, ident = heaps.all()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.id[heap], ident, score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def best_in_windows(anchors: Anchors, windows, k: int, scale: int):
    """A task: for each anchor and positive the ``k`` best rows of other labels whose scores lie in the positive's window.

    ``windows`` holds (first, positive_id, high, low): those of anchor i are first[i] to first[i + 1].
    """

    def run(batches):
        a, (first, positive, high, low) = anchors.value, windows.value
        heaps = Heaps(len(positive), k)
        per_anchor = np.diff(first)
        for ident, label, rows in candidate_tiles(batches, a.rows.shape[1], scale):
            for tile in a.tiles():
                scores = strassen(a.rows[tile], rows.T)
                foreign = a.label[tile][:, None] != label
                for j in range(int(per_anchor[tile].max(initial=0))):
                    has = np.flatnonzero(per_anchor[tile] > j)
                    w = first[tile][has] + j
                    s = scores[has]
                    i, c = np.nonzero((s >= np.maximum(low[w], heaps.floor(w))[:, None]) & (s <= high[w][:, None]) & foreign[has])
                    heaps.push(w[i], s[i, c], ident[c])
        heap, score, ident = heaps.all()
        anchor = np.repeat(a.id, per_anchor)
        columns = (anchor[heap], positive[heap], high[heap], ident, score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def best(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """Merges the heaps of all tasks: ``k`` rows for each of ``keys``, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(rows: DataFrame, ident: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) * scale < 2.0**63, F.lit(False)))  # false for NaN too
    rows = rows.select(
        ident.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    repeated = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    once = rows.join(repeated, F.col("id") == F.col("again"), "left_anti")
    least = rows.join(repeated, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return once.unionAll(least.select("id", "row.label", "row.vector"))


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels
    that score from ``low`` percent of the positive's score up to that score.

    Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchors`` is a condition on
    ``id``. A score is the inner product of floor(scale * x), taken exactly: higher ones come first, ties by smaller id.

    The anchors are a stated query set that meets all rows in blocks: a block of anchors, 16 MB with its heaps at most,
    goes to all tasks, each task multiplies tiles of it with tiles of its own rows, keeps one heap per anchor (then per
    positive), and Spark merges the heaps of the tasks. The first pass multiplies only rows of one label, the second
    needs the scores of the first. Each block reads the rows twice, which costs little beside some thousand products a row.

    Rows with a NULL id, label, vector or component, or a component that isn't finite or doesn't fit 64 bits when
    scaled, take no part; of rows that share an id the one with the smallest label, then vector, does. Vectors of unlike
    length are filled up with zeros. A negative best score has an empty window. Labels are integers. Scores beyond 64
    bits wrap around. Extra columns are ignored; without anchors, or in an empty table, the result is empty.
    """
    spark = rows.sparkSession
    kept = stored(usable(rows, F.col(id_col), F.col(label_col), F.col(vector_col), scale))
    chosen = kept.where(anchors)
    count, width = chosen.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = max(width or 0, 1)
    size = count * (8 * width + 32 * positives * (negatives + 1))
    blocks = 1 if size <= BLOCK_BYTES else -(-2 * size // BLOCK_BYTES)  # twice as many: hashes fill them unevenly
    found = []
    for block in range(blocks if count else 0):
        own = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("label", "id").toArrow()
        if not own.num_rows:
            continue
        own = own.combine_chunks().to_batches()[0]
        ids, labels = (np.asarray(own.column(c)) for c in (0, 1))
        sent = spark.sparkContext.broadcast(Anchors(ids, labels, matrix(own.column(2), width, scale)))
        near = kept.mapInArrow(nearest_of_label(sent, positives, scale), "anchor_id bigint, positive_id bigint, positive_score bigint")
        near = best(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank").toArrow()  # a few for each anchor of the block
        near = {c: np.asarray(near.column(c).combine_chunks()) for c in near.column_names}
        place = np.argsort(ids, kind="stable")
        place = place[np.searchsorted(ids, near["anchor_id"], sorter=place)]
        order = np.lexsort((near["positive_id"], place))
        high = near["positive_score"][order]
        least = high // 100 * low - (-(high % 100) * low) // 100  # the smallest integer from low percent on
        windows = spark.sparkContext.broadcast((np.searchsorted(place[order], np.arange(len(ids) + 1)), near["positive_id"][order], high, least))
        part = kept.mapInArrow(
            best_in_windows(sent, windows, negatives, scale),
            "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
        )
        found.append(stored(best(part, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)))
    if not found:
        found = [spark.createDataFrame([], "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint, rank int")]
    return reduce(DataFrame.unionAll, found).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
