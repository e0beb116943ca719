"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches, stored
from tradewind.llm.words import VISIBLE, Powers, byte_values, chunks, documents, mix, text_bytes, words


@dataclass(frozen=True)
class Settings:
    """``max_train``: labelled documents that are learnt from at most, a bounded sample of all that may be used.

    ``balance``: the rarer label's examples weigh (other / own count) to this power; 0 leaves all alike.
    """

    bits: int = 18
    max_train: int = 16_000
    shards: int = 4
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    balance: float = 0.5
    l1: float = 0.02
    l2: float = 0.5


def split_values() -> np.ndarray:
    return byte_values()


def features(data: np.ndarray, offsets: np.ndarray, powers: Powers, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and every pair of neighbouring words; a word twice in a row is one feature for all words.

    Feature 0 is left to the constant term.
    """
    w = words(data, offsets, powers, VISIBLE, split_values())
    doc = w.doc
    pair = doc[1:] == doc[:-1]
    both = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[pair]
    both[(w.hash[1:] == w.hash[:-1])[pair]] = np.uint64(0x5EED << 40)
    # The last byte of a word, and its rough length, seen apart from the word itself.
    shape = mix((data[w.ends - 1].astype(np.uint64) << np.uint64(8)) + np.minimum(w.ends - w.starts, 40).astype(np.uint64) // np.uint64(4)) if len(w.ends) else w.hash
    index = np.concatenate([w.hash, both, shape]) >> np.uint64(64 - bits)
    return np.concatenate([doc, doc[1:][pair], doc]), np.maximum(index.astype(np.int64), 1)


def rows_of(doc: np.ndarray, index: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (first, index, value): values are 1 + log(count), scaled to length one per document."""
    key, count = np.unique((doc.astype(np.int64) << bits) | index, return_counts=True)
    row, value = key >> bits, 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return np.searchsorted(row, np.arange(n + 1)), key & ((1 << bits) - 1), value / norm[row]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """Per-coordinate follow-the-regularised-leader for the logistic loss."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(self, i) -> np.ndarray:
        z, s = self.z[i], self.s
        step = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, step)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(i)
        g = weight * (sigmoid(w @ x) - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.s.alpha * w
        self.n[i] += g * g


def held_out(id_column: Column) -> Column:
    """True for the third of the ids that is never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings) -> np.ndarray:
    """Weights of all features, the constant term first.

    Of the usable labels the ``max_train`` with the smallest hashes of their ids are taken, so reruns agree. They are
    dealt into ``shards``; each shard is learnt by itself in ``epochs`` passes, and the weights are averaged.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    order = F.xxhash64(F.col("label_id").cast("string"))
    chosen = stored(known.distinct().orderBy(order, "label_id", "label").limit(s.max_train))
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("content"))
        .join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
        .select(F.col("id").cast("string").alias("id"), "label", F.coalesce("content", F.lit("")).alias("content"))
        .select(F.pmod(F.xxhash64("id"), F.lit(s.shards)).alias("shard"), "id", "label", F.md5(F.col("content").cast("binary")).alias("text"), "content")
    )

    def sparse(batches):
        """Texts become sparse rows where they are read: the learner gets their features, whose number is bounded, not the texts."""
        powers = Powers()
        for batch, data, offsets, i, j in documents(batches):
            first, index, x = rows_of(*features(data, offsets, powers, s.bits), j - i, s.bits)
            first = pa.array(first, pa.int32())
            own = [batch.column(c).slice(i, j - i) for c in range(4)]
            lists = [pa.ListArray.from_arrays(first, v) for v in (pa.array(index, pa.int32()), pa.array(x, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*own, *lists], ["shard", "id", "label", "text", "feature", "value"])

    bound_batches(docs.sparkSession)
    sample = sample.mapInArrow(sparse, "shard bigint, id string, label int, text string, feature array<int>, value array<float>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leader = Leader(s)
        # One order whatever the partitioning: by hash of the id, then by label and digest of the text.
        pdf = pdf.assign(h=pd.util.hash_array(pdf["id"].to_numpy(object))).sort_values(["h", "id", "label", "text"])
        made = [
            (np.append(0, i).astype(np.int32), np.append(np.float32(1), x), label)
            for i, x, label in zip(pdf["feature"], pdf["value"], pdf["label"], strict=True)
        ]
        count = np.bincount(pdf["label"], minlength=2) + 1
        weight = np.maximum(count[::-1] / count, 1.0) ** s.balance
        for _ in range(s.epochs):
            for i, x, label in made:
                leader.learn(i, x, label, weight[label])
        w = leader.weights(np.arange(1 << s.bits))
        some = np.flatnonzero(w)
        return pd.DataFrame({"feature": some, "weight": w[some], "rows": len(pdf)})

    parts = sample.groupBy("shard").applyInPandas(fit, "feature bigint, weight double, rows bigint")
    model = parts.toPandas().sort_values(["feature", "weight"])  # at most shards times features, added up in one order
    total = np.zeros(1 << s.bits)
    if len(model):
        np.add.at(total, model["feature"].to_numpy(), model["weight"].to_numpy() / s.shards)
    return total


def scorer(spark: SparkSession, weights: np.ndarray, s: Settings):
    """The score of a text column: the sparse dot product of its features and the weights."""
    bound_batches(spark)
    model = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        powers, out = Powers(), [np.zeros(0)]
        for i, j in chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            first, index, x = rows_of(*features(part, at, powers, s.bits), j - i, s.bits)
            row = np.repeat(np.arange(j - i), np.diff(first))
            out.append(sigmoid(np.bincount(row, model.value[index] * x, minlength=j - i) + model.value[0]))
        return pa.array(np.concatenate(out))

    return score


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    The label 1 stands for good. Labels of ids whose CRC32 (as text) leaves 1 modulo 3 are never read; only words
    are features. NULL and empty texts have the score of the constant term; NULL labels or ids and labels other than 0 and 1
    teach nothing; contradicting labels are both learnt; without labels every score is 0.5. Extra columns are ignored.
    """
    s = settings or Settings()
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, label_col, s), s)
    return docs.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col).cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
