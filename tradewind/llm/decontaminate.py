"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches, stored
from tradewind.llm.words import ALNUM, LOWER, Powers, Sums, byte_values, documents, words

BLOCK = 16 << 20  # bytes of benchmark text that are held against all documents at once
CROWD = 64  # windows of one word up to which each is a candidate at every place of the word
STEP = 1 << 20  # candidates that are looked at together


def folded_values() -> np.ndarray:
    return byte_values()[LOWER]


def item_words(text: str | None) -> list[bytes]:
    kept = bytes(LOWER[i] if ALNUM[i] else 32 for i in range(256))
    return (text or "").encode().translate(kept).split()


class Windows:
    """The windows of one block of items: each with its rarest word, by which documents find it.

    A window must occur whole, so of its words, ordered by rarity, the prefix that any match has to share is one
    word long. Windows of the same words are one entry with several items.
    """

    def __init__(self, items: list[tuple], size: int, counts: dict[int, int] | None):
        """items: (name, text). counts: places of a word's hash in all documents; None to gather vocabulary only."""
        powers, values, kinds = Powers(), folded_values(), {}
        for name, text in items:
            parts = item_words(text)
            k = min(size, len(parts))
            for i in range(len(parts) - k + 1 if k else 0):
                kinds.setdefault(b" ".join(parts[i : i + k]), set()).add(name)
        self.texts = sorted(kinds)
        self.items = [sorted(kinds[t] - {None}) for t in self.texts]
        data = np.frombuffer(b"\n".join(self.texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]).astype(np.int64)
        offsets[-1] = min(offsets[-1], len(data))
        w = words(data, offsets, powers, ALNUM, values)
        self.vocabulary = np.unique(w.hash)
        if counts is None:
            return
        self.lengths = np.diff(w.first)
        self.hashes = Sums(w.hash, powers).hash(w.first[:-1], w.first[1:])
        rarity = np.array([counts.get(int(h), 0) for h in w.hash.view(np.int64)], np.int64)
        # The rarest word of each window; of equally rare ones the one with the smallest hash, then the first.
        order = np.lexsort((np.arange(len(rarity)), w.hash, rarity, w.doc))
        chosen = order[w.first[:-1]] if len(order) else order
        self.place = chosen - w.first[:-1]
        word = w.hash[chosen]
        by_word = np.argsort(word, kind="stable")
        self.words, begin = np.unique(word[by_word], return_index=True)
        self.begin = np.append(begin, len(word))
        self.by_word = by_word
        # Windows of a word that files very many are found by the hash of their words: (place, length) -> their order by hash.
        self.crowded = np.diff(self.begin) > CROWD
        crowd = by_word[np.repeat(self.crowded, np.diff(self.begin))]
        self.by_hash = {}
        for p, n in sorted(set(zip(self.place[crowd].tolist(), self.lengths[crowd].tolist(), strict=True))):
            own = crowd[(self.place[crowd] == p) & (self.lengths[crowd] == n)]
            self.by_hash[p, n] = own[np.argsort(self.hashes[own], kind="stable")]
        self.absent = np.ones(1 << 16, bool)
        self.absent[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = False

    def find(self, data: np.ndarray, w, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of each occurrence in a chunk."""
        none = np.zeros(0, np.int64)
        if not len(self.words):
            return none, none
        at = np.flatnonzero(~self.absent[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.words, w.hash[at]), len(self.words) - 1)
        hit = self.words[slot] == w.hash[at]
        at, slot = at[hit], slot[hit]
        found = [], []
        many = self.crowded[slot]
        for x, v in zip(found, self.hashed(at[many], w, sums), strict=True):
            x.append(v)
        at, slot = at[~many], slot[~many]
        n = self.begin[slot + 1] - self.begin[slot]
        for i in range(0, len(at), STEP // CROWD):  # at most STEP candidates at once
            a, s, m = (x[i : i + STEP // CROWD] for x in (at, slot, n))
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            window = self.by_word[np.repeat(self.begin[s], m) + step]
            begin = np.repeat(a, m) - self.place[window]
            end = begin + self.lengths[window]
            doc = np.searchsorted(w.first, np.repeat(a, m), "right") - 1
            inside = (begin >= w.first[doc]) & (end <= w.first[doc + 1])
            window, begin, end = window[inside], begin[inside], end[inside]
            same = sums.hash(begin, end) == self.hashes[window]
            for x, v in zip(found, (window[same], begin[same]), strict=True):
                x.append(v)
        window, begin = (np.concatenate(x) if x else none for x in found)
        exact = np.zeros(len(window), bool)
        plain = None
        for i, (k, b) in enumerate(zip(window.tolist(), begin.tolist(), strict=True)):
            if plain is None:
                plain = LOWER[data].tobytes()
            run = range(b, b + int(self.lengths[k]))
            exact[i] = b" ".join(plain[w.starts[j] : w.ends[j]] for j in run) == self.texts[k]
        return window[exact], begin[exact]


    def hashed(self, at: np.ndarray, w, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """Candidates at words that file very many windows: one look-up for each place and length, not one per window."""
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        doc = np.searchsorted(w.first, at, "right") - 1
        for (p, n), own in self.by_hash.items():
            begin = at - p
            begin = begin[(begin >= w.first[doc]) & (begin + n <= w.first[doc + 1])]
            h, known = sums.hash(begin, begin + n), self.hashes[own]
            first, last = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            times = last - first  # 0 or 1, but for windows whose hashes clash
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found[0].append(own[np.repeat(first, times) + step])
            found[1].append(np.repeat(begin, times))
        return np.concatenate(found[0]), np.concatenate(found[1])


def merged(starts: np.ndarray, ends: np.ndarray) -> int:
    """How many words the spans cover together."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    before = np.concatenate([[0], reach[:-1]])
    return int(np.maximum(reach - np.maximum(starts, before), 0).sum())


def word_counts(base: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Places of each word of one block's vocabulary in all documents; as many rows as the block has words."""

    def count(batches):
        powers, values, total = Powers(), folded_values(), np.zeros(len(vocabulary), np.int64)
        for _, data, offsets, _, _ in documents(batches):
            h = words(data, offsets, powers, ALNUM, values).hash
            slot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(slot[vocabulary[slot] == h], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])], ["word", "n"])

    if not len(vocabulary):
        return {}
    rows = base.select("content").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def occurrences(base: DataFrame, items: list[tuple], size: int) -> DataFrame:
    """(id, row_key, n_words, n_hit, starts, ends, items) of each row against one block: hit windows, and whose they are."""
    counts = word_counts(base, Windows(items, size, None).vocabulary)
    index = base.sparkSession.sparkContext.broadcast(Windows(items, size, counts))

    def run(batches):
        powers, values, windows = Powers(), folded_values(), index.value
        for batch, data, offsets, i, j in documents(batches):
            w = words(data, offsets, powers, ALNUM, values)
            window, begin = windows.find(data, w, Sums(w.hash, powers))
            doc = np.searchsorted(w.first, begin, "right") - 1
            order = np.argsort(doc, kind="stable")
            window, begin = window[order], begin[order]
            cut = np.searchsorted(doc[order], np.arange(j - i + 1))
            local = begin - np.repeat(w.first[:-1], np.diff(cut))
            ends = local + windows.lengths[window] if len(window) else local
            whose = [sorted({n for k in set(window[a:b].tolist()) for n in windows.items[k]}) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            hit = [merged(local[a:b], ends[a:b]) if a < b else 0 for a, b in zip(cut[:-1], cut[1:], strict=True)]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(i, j - i) for c in (0, 1)],
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array(hit, pa.int64()),
                    lists(local),
                    lists(ends),
                    pa.array(whose, pa.list_(pa.string())),
                ],
                ["id", "row_key", "n_words", "n_hit", "starts", "ends", "items"],
            )

    kind = base.schema["id"].dataType.simpleString()
    return base.select("id", "row_key", "content").mapInArrow(
        run,
        f"id {kind}, row_key bigint, n_words bigint, n_hit bigint, starts array<bigint>, ends array<bigint>, items array<string>",
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block: int = BLOCK,
    carry_key: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``starts``, ``ends`` (word spans of hit windows).

    Words are lower-cased runs of ASCII letters, digits and all other than ASCII. A window is ``window`` consecutive
    words of an item, or the whole item if it has fewer; it is found where all its words stand in a row.

    The benchmark is the stated query set. It is cut into blocks of about ``block`` bytes, and each block goes over all
    documents: its vocabulary is counted in them, each window is filed under its rarest word, and a document word
    that is some window's rarest leads to the windows it may lie in. Those that reach over the document's borders
    go, hashes of the word sequences are compared, then the words themselves. A word that files very many windows (an item of few
    different words) leads to them by the hash of the document's words around it instead of one by one. Only one block is ever broadcast.

    NULL texts have no words; items without words have no windows and never occur; a NULL item id counts as no item,
    though its windows hit. Rows of ``docs`` that share id and text get the same result, items that repeat count once.
    Extra columns are ignored; an empty benchmark hits nothing. ``carry_key`` adds ``row_key``, a hash of id and text.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("content"))
    base = base.withColumn("row_key", F.xxhash64("id", "content"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("content"))
    items = stored(items.distinct())
    total = items.agg(F.sum(F.octet_length("content") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "content"), F.lit(blocks)) == b).toPandas()
        rows = [tuple(None if pd.isna(x) else x for x in pair) for pair in zip(part["item"], part["content"], strict=True)]
        hits = occurrences(base, rows, window)
        if out is None:
            out = hits
            continue
        more = (
            stored(hits.where(F.size("starts") > 0))
            .dropDuplicates(["id", "row_key"])
            .select(F.col("id").alias("i"), F.col("row_key").alias("k"), *[F.col(c).alias(f"more_{c}") for c in ("starts", "ends", "items")])
        )
        out = stored(out).join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("row_key") == F.col("k")), "left").select(
            "id", "row_key", "n_words", "n_hit", *[F.concat(c, F.coalesce(f"more_{c}", F.array().cast(out.schema[c].dataType))).alias(c) for c in ("starts", "ends", "items")]
        )

    if blocks > 1:  # windows of several blocks may overlap

        @F.pandas_udf("bigint")
        def covered(starts: pd.Series, ends: pd.Series) -> pd.Series:
            return pd.Series([merged(a, b) if len(a) else 0 for a, b in zip(starts, ends, strict=True)], dtype="int64")

        out = out.withColumn("n_hit", covered("starts", "ends"))
    return out.select(
        F.col("id").alias(id_col),
        *(["row_key"] if carry_key else []),
        "n_words",
        "n_hit",
        F.array_sort(F.array_distinct("items")).alias("items"),
        "starts",
        "ends",
    )
