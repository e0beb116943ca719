"""Removal of repeated byte strings: common prefixes of suffixes from a Burrows-Wheeler transform, up to a threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.seeds import Seeding, base_of, by_key, repeated_spans, spread, without_spans

LIGHT = 1024  # texts around equal anchors that go into one transform; of more, finer pieces do
AT_ONCE = 1 << 19  # bytes of text in one transform
PACKED = 8  # bytes of a suffix that are compared as one number


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts as they do; zeros follow the text."""
    x = np.concatenate([text, np.zeros(PACKED, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x[: len(text)]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least, and the packed first bytes of each suffix.

    Starts from packed bytes and doubles the compared length; only suffixes that still tie are sorted again.
    """
    n, first = len(text), packed(text)
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    head = np.flatnonzero(np.append(True, sorted_first[1:] != sorted_first[:-1]))
    group = np.repeat(head, np.diff(np.append(head, n)))
    # rank: place of the first suffix of its group, plus one; beyond the text zero
    rank = np.zeros(n + 2 * depth, np.uint32)
    rank[order] = group + 1
    tied = np.flatnonzero(np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n))))
    size = PACKED
    while size < depth and len(tied):
        suffix = order[tied]
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | rank[suffix + size]
        again = np.argsort(key, kind="stable")
        order[tied], key = suffix[again], key[again]
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(tied)))
        rank[order[tied]] = np.repeat(tied[starts], counts) + 1
        tied = tied[np.repeat(counts > 1, counts)]
        size *= 2
    return order, sorted_first


def long_common_prefix(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cut): suffixes in order, and whether each shares fewer than ``least`` bytes with the one before it.

    Common prefixes come by increasing value. An interval of the order holds all suffixes with some prefix of that
    length. Extended backwards by each byte that precedes them in the transform, it becomes the intervals of prefixes
    one longer; where such an interval ends and no shorter prefix has ended before, the common prefix is settled
    and the interval is kept for the next length. The first lengths are read off the packed bytes, and the walk stops
    at ``least``: what isn't settled by then shares at least so much.
    """
    n = len(text)
    order, first = suffix_order(text, least)
    transform = text[order - 1]  # the byte before each suffix; the first suffix has the last byte before it
    back = np.empty(n, np.int64)  # place of the suffix that is one byte longer
    by_byte = np.argsort(transform, kind="stable")
    back[by_byte] = np.arange(n)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    differ = first[1:] ^ first[:-1]
    cut[1:n] = differ != 0
    ends = np.flatnonzero((differ != 0) & (differ < np.uint64(1 << 8))) + 1  # agree in all packed bytes but the last
    borders = np.flatnonzero(cut)
    begins = borders[np.searchsorted(borders, ends) - 1]
    for _ in range(PACKED, least):
        if not len(ends):
            break
        which, at = spread(begins, ends - begins)
        longer = back[at]
        place = np.argsort(longer)
        longer, which, byte = longer[place], which[place], transform[at[place]]
        last = np.append((np.diff(longer) != 1) | (which[1:] != which[:-1]) | (byte[1:] != byte[:-1]), True)
        stop = np.flatnonzero(last)
        begin, end = longer[np.append(0, stop[:-1] + 1)], longer[stop] + 1
        fresh = ~cut[end]
        begins, ends = begin[fresh], end[fresh]
        cut[ends] = True
    return order, cut[:n]


def expanded(batches, s: Seeding):
    """The windows of each text that stand in another place too, as spans of bytes."""
    for table in by_key(batches, AT_ONCE):
        table = table.combine_chunks()
        n = table.column("n").to_numpy()
        texts = table.column("content").to_pylist()
        lengths = np.array([len(t) for t in texts])
        # Texts end in a zero byte; no window reaches across one.
        text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        first = np.cumsum(lengths + 1) - lengths - 1
        order, cut = long_common_prefix(text, s.window)
        row = np.repeat(np.arange(len(texts)), lengths + 1)
        whole = np.arange(len(text)) + s.window <= (first + lengths)[row]
        same = np.cumsum(cut) - 1
        weight = np.bincount(same, np.where(whole, n[row], 0)[order])
        found = np.sort(order[(weight[same] > 1) & whole[order]])
        # Neighbouring windows are one span.
        edge = np.flatnonzero(np.append(True, (np.diff(found) != 1) | (np.diff(row[found]) != 0))) if len(found) else found
        low, high = found[edge], found[np.append(edge[1:], len(found)) - 1] + s.window if len(found) else found
        owner = row[low]
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        spans = pa.StructArray.from_arrays([pa.array((x - first[owner]).astype(np.int32)) for x in (low, high)], ["low", "high"])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)
        done = pa.Table.from_arrays([table.column("key"), table.column("around"), lists], ["key", "around", "spans"])
        yield from done.filter(pa.array(np.diff(at) > 0)).combine_chunks().to_batches()


def suffix_dedup(
    docs: DataFrame, window: int = 200, gram: int = 48, parts: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``removed`` (maximal runs of bytes), ``kept`` (binary).

    Texts are UTF-8 bytes. A byte goes if a string of ``window`` bytes that covers it also starts somewhere else, in the
    same document or another. Repeats are judged on the input, so no copy is spared, and may overlap. What is left is
    joined; it need not be valid UTF-8, hence binary.

    Which strings repeat is decided on common prefixes of suffixes, from Burrows-Wheeler transforms of bounded size: each
    holds all texts around some anchors, once each. Texts that are alone around their anchor, or the only one there, need none.

    NULL texts are empty. Rows that share id and text are copies of each other. Extra columns are ignored; an empty table
    gives an empty result.
    """
    s = Seeding(window, gram, parts, False)
    base = base_of(docs, id_col, text_col)

    def resolve(variants, s):
        return variants.mapInArrow(lambda batches: expanded(batches, s), "key bigint, around bigint, spans array<struct<low:int,high:int>>")

    spans = repeated_spans(base, s, resolve, LIGHT)
    return without_spans(base, spans, s).select(
        F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "removed", "kept"
    )
