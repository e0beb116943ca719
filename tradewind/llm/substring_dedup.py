"""Removal of repeated word sequences: documents meet on winnowed anchors, and matches are extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.seeds import Seeding, base_of, by_key, repeated_spans, spread, without_spans
from tradewind.llm.words import VISIBLE, Powers, byte_values, words

LIGHT = 32  # texts around equal anchors that are compared with one another; of more, finer pieces are
AT_ONCE = 1 << 20


def extended(batches, s: Seeding):
    """Compares the texts around equal anchors pair by pair: how far the pair agrees to the left and the right of it."""
    for table in by_key(batches, AT_ONCE):
        table = table.combine_chunks()
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        texts = table.column("content").to_pylist()
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        offsets[-1] = len(data)
        w = words(data, offsets, Powers(), VISIBLE, byte_values())
        # Rows of units, aligned at the anchor; beyond a text each row has values of its own.
        left = table.column("anchor_at").to_numpy()
        length = np.diff(w.first)
        wide = s.window - s.gram
        rows = np.arange(len(key))[:, None].astype(np.uint64) * np.uint64(2)
        grid = np.broadcast_to(rows, (len(key), 2 * s.window)).copy()
        which, at = spread(w.first[:-1], length)
        grid[which, wide - left[which] + at - w.first[which]] = w.hash[at] | np.uint64(1)
        begin = np.searchsorted(key, key, "left")
        a, b = spread(begin, np.searchsorted(key, key, "right") - begin)
        pair = (a != b) & (n[a] == 1)
        a, b = a[pair], b[pair]
        out = []
        for i in range(0, len(a), 1 << 15):
            x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            same = grid[x] == grid[y]
            stop = np.zeros((len(x), 1), bool)
            back = np.argmin(np.hstack([same[:, :wide][:, ::-1], stop]), axis=1)
            ahead = np.argmin(np.hstack([same[:, wide:], stop]), axis=1)
            long = back + ahead >= s.window
            out.append(np.stack([x, wide - back, wide + ahead], axis=1)[long])
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
        row = found[:, 0]
        cut = np.searchsorted(row, np.arange(len(key) + 1))
        shift = (wide - left)[row]
        spans = pa.StructArray.from_arrays([pa.array((found[:, c] - shift).astype(np.int32)) for c in (1, 2)], ["low", "high"])
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans)
        done = pa.Table.from_arrays([table.column("key"), table.column("around"), lists], ["key", "around", "spans"])
        yield from done.filter(pa.array(np.diff(cut) > 0)).combine_chunks().to_batches()


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``removed`` (runs of words), ``kept_text``.

    Words are runs of anything but ASCII white space. A word goes if it lies in ``window`` consecutive words of its
    document that stand somewhere else too, in the same document or another; that is, in a maximal repeat of that
    length or more. Repeats are judged on the input, so no copy is spared. The words left are joined by single spaces.

    NULL texts have no words. Rows that share id and text are copies of each other. Extra columns are ignored; an empty
    table gives an empty result.
    """
    s = Seeding(window, gram, 1, True)
    base = base_of(docs, id_col, text_col)

    def resolve(variants, s):
        return variants.mapInArrow(lambda batches: extended(batches, s), "key bigint, around bigint, spans array<struct<low:int,high:int>>")

    spans = repeated_spans(base, s, resolve, LIGHT)
    return without_spans(base, spans, s).select(
        F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "removed", F.col("kept").cast("string").alias("kept_text")
    )
