"""Quality rules: statistics of every text, hard limits, and an isolation forest over the statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches, stored
from tradewind.llm.words import VISIBLE, Powers, Sums, byte_values, documents, sequences, words


@dataclass(frozen=True)
class Settings:
    """``max_train``: labelled good documents that the forest is grown from at most, a bounded sample of all of them;
    the threshold is set on every labelled document.

    ``subsample``: documents a tree is grown from. ``max_loss``: share of the good labelled documents that may be rejected.
    """

    max_train: int = 8_192
    trees: int = 96
    subsample: int = 256
    depth: int = 12
    bins: int = 2_000
    max_loss: float = 0.001
    seed: int = 7


SYMBOLS, UPPER = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"#*$%&|<>", bytes(range(65, 91))))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_symbol_words", "n_upper")


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether another of its group has its value, and whether one before it has."""
    order = np.lexsort((value, group))  # stable: equal ones stay in order
    same = (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])
    again, twice = np.zeros(len(value), bool), np.zeros(len(value), bool)
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def statistics(data: np.ndarray, offsets: np.ndarray, powers: Powers, values: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of each text of a chunk."""
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[offsets[1:]] - total[offsets[:-1]]

    w = words(data, offsets, powers, VISIBLE, values)
    at, hashes = sequences(w, 3, powers)
    twice, _ = repeated(w.doc[at], hashes)
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    covered = np.cumsum(edge[:-1]) > 0

    # Lines end at line feeds and at the end of their text.
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    text = np.concatenate([np.searchsorted(offsets, feeds, "right") - 1, np.arange(n)])
    text = text[np.argsort(np.concatenate([feeds, offsets[1:]]), kind="stable")]
    order = np.lexsort((ends, text))
    ends, text = ends[order], text[order]
    starts = np.where(np.append(True, text[1:] != text[:-1]), offsets[text], np.append(0, ends[:-1] + 1)) if n else ends
    visible, symbols = VISIBLE[data], np.append(0, np.cumsum(SYMBOLS[data]))
    seen = np.append(0, np.cumsum(visible))
    full = seen[ends] > seen[starts]
    _, again = repeated(text[full], Sums(values[data], powers).hash(starts[full], ends[full]))
    return [
        np.diff(w.first),
        per_text(visible & ((data & 0xC0) != 0x80)),
        per_text(SYMBOLS[data]),
        np.bincount(text[full][again], minlength=n),
        np.bincount(w.doc[covered], minlength=n),
        np.bincount(w.doc[symbols[w.ends] > symbols[w.starts]], minlength=n),
        per_text(UPPER[data]),
    ]


def text_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``COUNTS``) of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("content"))

    def run(batches):
        powers, values = Powers(), byte_values()
        for batch, data, offsets, i, j in documents(batches):
            counts = statistics(data, offsets, powers, values)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c.astype(np.int64)) for c in counts]], ["id", *COUNTS])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: What the forest sees: shares, so that long texts are no outliers by their length. Repeated lines are counted but
#: not among them: good documents have them as often as bad ones.
SHARES = ("word_chars / n_words", "n_symbol_words / n_words", "n_repeat_words / n_words", "n_upper / word_chars")


def usual_depth(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees. A split is a random value of a random statistic within the box of its node.

    The root's box spans all labelled rows, not only the rows that a tree is grown from: a statistic that is the same in
    all good documents still gets splits, and what lies beyond them is alone at once.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, s: Settings):
        random = np.random.default_rng(s.seed)
        self.size = min(s.subsample, len(rows))
        trees = [self.grow(rows[random.choice(len(rows), self.size, replace=False)], low, high, s, random) for _ in range(s.trees)]
        width = max(len(t) for t in trees)
        nodes = np.zeros((len(trees), width, 5))
        for k, t in enumerate(trees):
            nodes[k, : len(t)] = t
        self.feature, self.left, self.right = (nodes[:, :, c].astype(np.int32) for c in (0, 2, 3))
        self.split, self.length, self.depth = nodes[:, :, 1].copy(), nodes[:, :, 4].copy(), s.depth

    @staticmethod
    def grow(rows, low, high, s, random) -> list[tuple]:
        """Nodes (statistic, split, left, right, path length); those of a leaf lead back to itself."""
        nodes: list[tuple] = [()]
        work = [(0, rows, low, high, 0)]
        while work:
            at, rows, low, high, depth = work.pop()
            wide = np.flatnonzero(high > low)
            if len(rows) <= 1 or depth == s.depth or not len(wide):
                nodes[at] = (0, 0.0, at, at, depth + float(usual_depth(len(rows))))
                continue
            f = int(random.choice(wide))
            split = random.uniform(low[f], high[f])
            less, above, below = rows[:, f] < split, low.copy(), high.copy()
            below[f] = above[f] = split
            nodes[at] = (f, split, len(nodes), len(nodes) + 1, 0.0)
            work += [(len(nodes), rows[less], low, below, depth + 1), (len(nodes) + 1, rows[~less], above, high, depth + 1)]
            nodes += [(), ()]
        return nodes

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: 2 to the power of minus the mean path length over the usual one; high for outliers."""
        tree, out = np.arange(len(self.split))[:, None], []
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512].T
            node = np.zeros((len(self.split), part.shape[1]), np.int32)
            for _ in range(self.depth):
                less = part[self.feature[tree, node], np.arange(part.shape[1])] < self.split[tree, node]
                node = np.where(less, self.left[tree, node], self.right[tree, node])
            out.append(2.0 ** (-self.length[tree, node].mean(0) / max(float(usual_depth(self.size)), 1.0)))
        return np.concatenate(out) if out else np.zeros(0)


def threshold_of(good: np.ndarray, bad: np.ndarray, max_loss: float) -> int:
    """The bin from which documents are rejected, by counts of good and bad labelled ones in each bin of the score.

    Of the bins that lose at most ``max_loss`` of the good, those that catch most of the bad; of these the middle one.
    """
    lost, caught = np.append(np.cumsum(good[::-1])[::-1], 0), np.append(np.cumsum(bad[::-1])[::-1], 0)
    may = np.flatnonzero(lost <= max_loss * good.sum())
    return int(np.median(may[caught[may] == caught[may].max()]))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    settings: Settings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, the counts of the contract, ``base_failed``, ``kept`` and the forest's ``score``.

    Counts: ``n_words`` (runs of anything but ASCII white space), ``word_chars`` (code points in them), ``n_symbols``
    (of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier one), ``n_repeat_words`` (words in three-word
    windows that the text has twice or more). ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them repeated. The forest is grown from labelled good documents that pass these limits; the threshold of its
    score comes from all labelled documents that pass. Equal lines and windows are found by 64-bit hashes within a text.

    NULL texts are empty. NULL labels or ids, and labels other than 0 and 1, count for nothing; an id with both labels
    counts as both; rows that repeat an id count each. Without good and bad labels the limits alone decide. Extra columns are ignored.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    counted = stored(text_statistics(docs, id_col, text_col))
    shares = F.array(*[F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0)) for a, b in (x.split(" / ") for x in SHARES)])
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rows = counted.withColumns({"base_failed": failed, "shares": shares})

    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull()).distinct()
    passing = stored(rows.where(~failed).join(known, F.col("id") == F.col("label_id")).select("id", "label", "shares"))
    span = passing.agg(*[f(F.get("shares", F.lit(k))) for f in (F.min, F.max) for k in range(len(SHARES))]).first()
    order = F.xxhash64(F.col("id").cast("string"))
    sample = passing.where("label = 1").orderBy(order, "id", *[F.get("shares", F.lit(k)) for k in range(len(SHARES))]).limit(s.max_train).select("shares").collect()
    if span[0] is None or len(sample) < 2:
        return rows.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", (~failed).alias("kept"), F.lit(0.0).alias("score"))

    low, high = np.array(span[: len(SHARES)]), np.array(span[len(SHARES) :])
    forest = spark.sparkContext.broadcast(Forest(np.array([r.shares for r in sample]), low, high + (high - low) * 1e-9, s))

    @F.arrow_udf("double")
    def score(shares: pa.Array) -> pa.Array:
        return pa.array(forest.value.score(np.asarray(shares.flatten()).reshape(len(shares), len(SHARES))))

    place = F.least((F.col("score") * s.bins).cast("int"), F.lit(s.bins - 1))
    seen = passing.withColumn("score", score("shares")).groupBy(place.alias("bin"), "label").count().collect()  # at most two a bin
    count = np.zeros((2, s.bins), np.int64)
    for r in seen:
        count[r["label"], r["bin"]] = r["count"]
    limit = threshold_of(count[1], count[0], s.max_loss) if count[0].sum() else s.bins
    scored = rows.withColumn("score", score("shares"))
    return scored.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", (~F.col("base_failed") & (place < limit)).alias("kept"), "score")
