"""Repeats of a minimum length, found from winnowed anchors: where they may be, which are certain, which need a closer look.

A text is a sequence of units (bytes or words), a window is ``window`` consecutive units of one text. Each window has
one anchor: of its runs of ``gram`` units the first whose hash is smallest. So equal windows have equal anchors at
equal places, and all windows that an anchor stands for lie in a short stretch around it. Stretches are cut by the
distance of window and anchor into at most ``parts`` pieces; the units common to all possible windows of a piece
are its key. Two equal windows are in pieces of equal keys, whatever the texts around them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches, membership, stored
from tradewind.llm.words import VISIBLE, Powers, Sums, byte_values, chunks, mix, text_bytes, words

BITS = 1 << 25  # a membership bitmap of 4 MB
BYTES_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Seeding:
    window: int
    gram: int
    parts: int
    words: bool

    @property
    def step(self) -> int:
        """Windows of a piece, at most."""
        return -(-(self.window - self.gram + 1) // self.parts)


def slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """The smallest or largest (``take``: np.minimum, np.maximum) of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def spread(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of the ranges begins[i], begins[i] + 1, ... with counts[i] values each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[which]


def stretches(values: np.ndarray, first: np.ndarray, s: Seeding, powers: Powers):
    """(sums, place, anchor, low, high): the windows that begin at low to high have this anchor, at ``place``.

    Text d is units ``first[d]`` to ``first[d + 1]``.
    """
    n, k, w = len(values), s.gram, s.window - s.gram + 1
    sums, none = Sums(values, powers), np.zeros(0, np.int64)
    if n < s.window:
        return sums, none, none.astype(np.uint64), none, none
    h = mix((sums.sums[k:] - sums.sums[:-k]) * sums.down[: n - k + 1] + np.uint64(k))
    least = slide(h, w, np.minimum)
    crossing = np.zeros(len(least) + 1, np.int32)
    np.add.at(crossing, np.clip(first[1:-1] - s.window + 1, 0, len(least)), 1)
    np.add.at(crossing, np.clip(first[1:-1], 0, len(least)), -1)
    inside = np.cumsum(crossing)[:-1] == 0
    change = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1
    begin, end = np.append(0, change), np.append(change, len(least)) - 1
    real = inside[begin]
    begin, end = begin[real], end[real]
    value = least[begin]
    least[~inside] = 0
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    # Of the chosen places in the windows begin to end, those with the smallest hash; each serves the windows after the one before.
    at = np.searchsorted(chosen, begin)
    run, at = spread(at, np.searchsorted(chosen, end + w - 1, "right") - at)
    place = chosen[at]
    mine = h[place] == value[run]
    run, place = run[mine], place[mine]
    low = begin[run]
    again = np.append(False, run[1:] == run[:-1])
    low[again] = np.maximum(low[again], place[:-1][again[1:]] + 1)
    high = np.minimum(end[run], place)
    some = low <= high
    return sums, place[some], value[run[some]], low[some], high[some]


def pieces(sums: Sums, place: np.ndarray, low: np.ndarray, high: np.ndarray, s: Seeding):
    """(which, key, around, low, end) of the pieces of these stretches: units low to end hold all windows of the piece;
    ``around`` is their hash and the anchor's place in them."""
    out = []
    for q in range(s.parts):
        near, far = q * s.step, min(s.window - s.gram, (q + 1) * s.step - 1)
        a, b = np.maximum(low, place - far), np.minimum(high, place - near)
        which = np.flatnonzero(a <= b)
        p, a, end = place[which], a[which], b[which] + s.window
        key = mix(sums.hash(p - near, p - far + s.window) + np.uint64(q))
        out.append((which, key, mix(sums.hash(a, end) + (p - a).astype(np.uint64)), a, end))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def units(batches, s: Seeding, powers: Powers):
    """(batch, rows from, to, bytes, byte offsets, unit hashes, first unit of each text, unit begins, unit ends) chunk by chunk."""
    values = byte_values()
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("content")))
        for i, j in chunks(offsets, BYTES_AT_ONCE):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if s.words:
                w = words(d, o, powers, VISIBLE, values)
                yield batch, i, j, d, w.hash, w.first, w.starts, w.ends
            else:
                yield batch, i, j, d, values[d], o, None, None


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """The set bits of a membership bitmap as one array of ``BITS / 8`` bytes, whatever the number of keys."""
    out = np.zeros(BITS // 8, np.uint8)
    for r in membership(keys, F.col(name), BITS).toLocalIterator():
        part = np.frombuffer(r["bitmap"], np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the bitmap. The bit of a key is its remainder, as in ``membership``."""
    at = (keys & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def base_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("content"))
    return base.select("id", F.xxhash64("id", "content").alias("row_key"), "content")


def repeated_anchors(base: DataFrame, s: Seeding) -> DataFrame:
    """The anchors that stand at two places or more."""

    def run(batches):
        powers = Powers()
        for _, _, _, _, values, first, _, _ in units(batches, s, powers):
            _, _, anchor, _, _ = stretches(values, first, s, powers)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return base.select("content").mapInArrow(run, "anchor bigint").groupBy("anchor").count().where("count > 1").select("anchor")


def scan(base: DataFrame, s: Seeding, anchors, keys=None) -> DataFrame:
    """The pieces whose anchors may be repeated: (id, row_key, key, around, low, high) with the units that hold the windows.

    With ``keys``, only pieces of these keys, as (key, around, anchor_at, content): the units' text, words
    joined by spaces, and the place of the anchor among them.
    """

    def run(batches):
        powers = Powers()
        for batch, i, _, data, values, first, starts, ends in units(batches, s, powers):
            sums, place, anchor, low, high = stretches(values, first, s, powers)
            may = among(anchors.value, anchor)
            place = place[may]
            which, key, around, low, end = pieces(sums, place, low[may], high[may], s)
            if keys is not None:
                may = among(keys.value, key)
                key, around, low, end, place = key[may], around[may], low[may], end[may], place[which[may]]
                _, one = np.unique(around, return_index=True)  # one copy a chunk will do
                key, around, low, end, place = key[one], around[one], low[one], end[one], place[one]
                if s.words:
                    plain = data.tobytes()
                    a, b = starts.tolist(), ends.tolist()
                    text = [b" ".join(plain[a[u] : b[u]] for u in range(x, y)) for x, y in zip(low.tolist(), end.tolist(), strict=True)]
                else:
                    plain = data.tobytes()
                    text = [plain[x:y] for x, y in zip(low.tolist(), end.tolist(), strict=True)]
                rows = [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array((place - low).astype(np.int32)), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["key", "around", "anchor_at", "content"])
                continue
            doc = np.searchsorted(first, low, "right") - 1
            own = [batch.column(c).take(pa.array(doc + i)) for c in (0, 1)]
            begin = first[doc]
            rest = [pa.array(x) for x in (key.view(np.int64), around.view(np.int64), (low - begin).astype(np.int32), (end - begin).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*own, *rest], ["id", "row_key", "key", "around", "low", "high"])

    if keys is not None:
        return base.mapInArrow(run, "key bigint, around bigint, anchor_at int, content binary")
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, row_key bigint, key bigint, around bigint, low int, high int")


def finer_pieces(variants: DataFrame, s: Seeding) -> DataFrame:
    """The variants cut by the distance of window and anchor into the pieces of ``s``: each row with (sub_key, sub_around,
    sub_at, sub_content), and where the piece begins in it, ``low``, and its number of units, ``size``."""

    def run(batches):
        powers, values = Powers(), byte_values()
        for batch in batches:
            data, offsets = text_bytes(batch.column("content").cast(pa.large_binary()).view(pa.large_string()))
            at = batch.column("anchor_at").to_numpy().astype(np.int64)
            for i, j in chunks(offsets, BYTES_AT_ONCE):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = words(d, o, powers, VISIBLE, values) if s.words else None
                v, first = (w.hash, w.first) if s.words else (values[d], o)
                sums = Sums(v, powers)
                which, key, around, low, end = pieces(sums, first[:-1] + at[i:j], first[:-1], first[1:] - s.window, s)
                plain = d.tobytes()
                begins, ends = (w.starts[low], w.ends[end - 1]) if s.words else (low, end)
                # Words are joined by single spaces already, so a piece is one run of bytes.
                text = [plain[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                own = [batch.column(c).take(pa.array(which + i)) for c in ("key", "around", "n")]
                place = (first[:-1] + at[i:j])[which] - low
                rest = [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(text, pa.binary())]
                rest += [pa.array((low - first[:-1][which]).astype(np.int32)), pa.array((end - low).astype(np.int32))]
                names = ["key", "around", "n", "sub_key", "sub_around", "sub_at", "sub_content", "low", "size"]
                yield pa.RecordBatch.from_arrays([*own, *rest], names)

    return variants.mapInArrow(
        run, "key bigint, around bigint, n bigint, sub_key bigint, sub_around bigint, sub_at int, sub_content binary, low int, size int"
    )


def resolved(variants: DataFrame, s: Seeding, resolve, light: int) -> DataFrame:
    """(key, around, spans) of stored variants (key, texts, around, n, anchor_at, content), all ``texts`` texts of each key.

    A key with more than ``light`` texts is cut into finer pieces, whose keys hold more of the units around the anchor: two
    equal windows are in pieces of one finer key too, so no match is lost, and texts that differ near the anchor part. That goes on for
    the finer keys that are still crowded; a piece of one window has one text to a key. Whatever the crowd, every
    comparison is made by ``resolve`` within a bounded group, and equal texts are one row with their number ``n``.
    """
    few, many = variants.where(F.col("texts") <= light).drop("texts"), variants.where(F.col("texts") > light).drop("texts")
    # A fixed number of tasks: these are long for their few bytes, so small partitions must not be put together.
    tasks = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = resolve(few.repartition(tasks, "key").sortWithinPartitions("key"), s)
    if many.isEmpty():
        return found
    finer = replace(s, parts=min(s.window - s.gram + 1, 4 * s.parts))
    cut = stored(finer_pieces(many, finer))
    texts = stored(
        cut.groupBy(F.col("sub_key").alias("key"), F.col("sub_around").alias("around")).agg(
            F.sum("n").alias("n"), F.first("sub_at").alias("anchor_at"), F.first("sub_content").alias("content"), F.first("size").alias("size")
        )
    )
    crowds = texts.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("texts")).where("texts > 1 and least = 1").drop("least")
    inner = resolved(stored(texts.join(crowds, "key").drop("size")), finer, resolve, light)
    single = texts.where("n = 1").select("key", "around")
    whole = texts.where("n > 1").select("key", "around", F.array(F.struct(F.lit(0).alias("low"), F.col("size").alias("high"))).alias("spans"))
    verdict = whole.unionAll(inner.join(single, ["key", "around"], "left_semi")).select(
        F.col("key").alias("sub_key"), F.col("around").alias("sub_around"), "spans"
    )
    moved = F.transform("spans", lambda x: F.struct((x["low"] + F.col("low")).alias("low"), (x["high"] + F.col("low")).alias("high")))
    back = cut.drop("sub_content").join(verdict, ["sub_key", "sub_around"]).select("key", "around", moved.alias("spans"))
    return found.unionAll(back.groupBy("key", "around").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated_spans(base: DataFrame, s: Seeding, resolve, light: int) -> DataFrame:
    """(id, row_key, spans): the units of each row that windows with a copy elsewhere cover; spans may overlap.

    ``resolve(variants, s)`` takes distinct texts of equal keys, (key, around, n, anchor_at, content) with ``n`` places each, at
    most ``light`` to a key, all rows of a key in one task and together, and returns (key, around, spans).

    Pieces of equal texts are counted first, so copies cost one row: a piece that stands at two places repeats as a
    whole, and a key at one place only can't repeat. What is left are keys with several texts, one of them at
    a single place. Their texts are read again and resolved.
    """
    context = base.sparkSession.sparkContext
    anchors = context.broadcast(bitmap(repeated_anchors(base, s), "anchor"))
    places = stored(scan(base, s, anchors))
    variants = stored(places.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n")))
    open_keys = stored(
        variants.groupBy("key")
        .agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("texts"))
        .where("texts > 1 and least = 1")
        .select("key", "texts")
    )
    keys = context.broadcast(bitmap(open_keys, "key"))
    read = scan(base, s, anchors, keys).groupBy("key", "around").agg(F.first("anchor_at").alias("anchor_at"), F.first("content").alias("content"))
    mixed = stored(variants.join(open_keys, "key").join(read, ["key", "around"]).select("key", "around", "n", "texts", "anchor_at", "content"))
    partly = resolved(mixed, s, resolve, light)
    empty = F.lit(None).cast("array<struct<low:int,high:int>>")
    whole = variants.where("n > 1").select("key", "around", empty.alias("spans"))
    single = variants.where("n = 1").select("key", "around")
    verdict = stored(whole.unionAll(partly.join(single, ["key", "around"], "left_semi")))
    moved = F.transform("spans", lambda x: F.struct((x["low"] + F.col("low")).alias("low"), (x["high"] + F.col("low")).alias("high")))
    return (
        places.join(verdict, ["key", "around"])
        .select("id", "row_key", F.coalesce(moved, F.array(F.struct("low", "high"))).alias("spans"))
        .groupBy("id", "row_key")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def joined_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of units that the (low, high) rows cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return list(zip(spans[new, 0].tolist(), reach[np.append(new[1:], len(spans)) - 1].tolist(), strict=True))


def without_spans(base: DataFrame, spans: DataFrame, s: Seeding) -> DataFrame:
    """(id, n_units, n_removed, removed, kept) of each row: what is left of its units, and the maximal runs that went."""

    def run(batches):
        for batch in batches:
            rows = []
            lists = batch.column("spans")
            for k, text in enumerate(batch.column("content")):
                text = (text.as_py() or "").encode()
                parts = text.split() if s.words else text
                runs = []
                if lists[k].is_valid:
                    flat = lists[k].values.flatten()
                    runs = joined_spans(np.stack([x.to_numpy() for x in flat], axis=1))
                kept, at = [], 0
                for a, b in [*runs, (len(parts), len(parts))]:
                    kept.append(parts[at:a])
                    at = b
                left = b" ".join(w for p in kept for w in p) if s.words else b"".join(kept)
                rows.append((len(parts), sum(b - a for a, b in runs), [{"low": a, "high": b} for a, b in runs], left))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct({"low": pa.int64(), "high": pa.int64()})), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", "n_units", "n_removed", "removed", "kept"])

    spans = spans.select(F.col("id").alias("span_id"), F.col("row_key").alias("span_key"), "spans")
    match = F.col("id").eqNullSafe(F.col("span_id")) & (F.col("row_key") == F.col("span_key"))
    joined = base.join(spans.hint("shuffle_hash"), match, "left").select("id", "content", "spans")
    kind = base.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_units bigint, n_removed bigint, removed array<struct<low:bigint,high:bigint>>, kept binary")


def by_key(batches, size: int):
    """Arrow tables of whole keys, of about ``size`` bytes of content, from batches sorted by key."""
    waiting, total = [], 0
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        total += batch.column("content").nbytes
        if total < size:
            continue
        table = pa.Table.from_batches(waiting)
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            waiting = table.slice(cut).combine_chunks().to_batches()
            total = sum(b.column("content").nbytes for b in waiting)
    if waiting:
        yield pa.Table.from_batches(waiting)
