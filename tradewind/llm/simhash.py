"""SimHash fingerprints and their links within a small radius by covering locality-sensitive hashing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.graph import components
from tradewind.llm.store import bound_batches, stored
from tradewind.llm.words import LOWER, MULTIPLIER, mix

HASH_SEED = 42
RADIUS = 2  # differing bits of a link; near_links handles buckets of any size for this radius
LIGHT = 32  # fingerprints in a bucket that are compared with one another
MISSED = 1e-9  # the share of pairs just similar enough that no band of a wide fingerprint brings together
IN_BUCKET = 256  # wide fingerprints that a bucket of a band holds on average, at most
CROWD = 2048  # wide fingerprints in a bucket that are compared with one another
COMPARED = 2  # words outside a band that members of its buckets are compared by; at 4, the radius misses sets of 4 and 5 shingles


def fingerprint(text: bytes, shingle: int, folded: bytes = LOWER.tobytes()) -> int:
    """SimHash of the XXH64 of all shingles of lower-cased words, as a signed 64-bit number."""
    parts = text.translate(folded).split()
    if not parts:
        return 0
    plain = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        some = zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)
        h = np.array([xxhash.xxh64_intdigest(plain[a:b], HASH_SEED) for a, b in some], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: list[str]) -> DataFrame:
    """(id, the columns ``carry``, fp) for each row."""
    base = docs.select(
        F.col(text_col).cast("string").alias("content"), F.col(id_col).alias("id"), *[F.col(c).alias(f"carried_{c}") for c in carry]
    )
    rest = base.columns[1:]
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            out = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.int64())], [*rest, "fp"])

    return base.mapInArrow(run, base.select(*rest).schema.add("fp", "long"))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2**(radius + 1) - 1 masks such that for any ``radius`` positions some mask leaves all of them out.

    Each position gets a non-zero vector of radius + 1 bits; the mask of a non-zero vector v keeps the positions whose
    vectors have an odd product with v. ``radius`` linear equations leave a non-zero v, so two fingerprints that
    differ in at most ``radius`` bits agree under some mask.
    """
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most two bits apart, and no others.

    Pairs that share a bucket of a covering mask are compared if the bucket is light. In a heavier bucket each
    fingerprint is sent to itself and to all fingerprints one bit away in the positions that the mask leaves out: two
    within distance 2 meet at one of these, where all are linked to the smallest. That is linear in the size of
    the bucket and exact: those that meet are at most 2 apart. A meeting place has at most 65 members.
    """
    masks = covering_masks(RADIUS)
    rows = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]
    buckets = stored(prints.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.t", "x.key", "fp"))
    sizes = stored(buckets.groupBy("t", "key").count().where("count > 1"))
    light = buckets.join(sizes.where(F.col("count") <= LIGHT), ["t", "key"], "left_semi")
    pairs = (
        light.withColumnRenamed("fp", "a")
        .join(light.withColumnRenamed("fp", "b"), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    heavy = buckets.join(sizes.where(F.col("count") > LIGHT), ["t", "key"], "left_semi")
    free = [[0] + [1 << i for i in range(64) if not m >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in f]) for f in free]), F.col("t") + 1)
    met = (
        heavy.select("t", "key", "fp", F.explode(flips).alias("flip"))
        .groupBy("t", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return pairs.unionAll(met).distinct()


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``, ``component`` (a number that
    all documents of a class share), and the columns ``carry`` of the input.

    Documents whose fingerprints differ in at most two bits are linked; ``component_id`` is the smallest id that
    links reach. Equal fingerprints are one class from the start, so groups of copies of any size cost one row.

    NULL texts have no words, as empty ones; their fingerprint is zero, and it is linked like any other. A NULL id is
    linked too but never names a component. Extra columns are ignored; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, carry or []))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")))
    comps = stored(components(near_links(classes)))
    named = stored(
        classes.join(comps, F.col("fp") == F.col("node"), "left").select(
            F.col("fp").alias("of_fp"), F.coalesce("component", "fp").alias("component"), "low"
        )
    )
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = stored(named.join(lows, "component").select("of_fp", "component", "component_id"))
    return prints.join(ids, F.col("fp") == F.col("of_fp")).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component",
        *[F.col(f"carried_{c}").alias(c) for c in carry or []],
    )


@dataclass(frozen=True)
class Bands:
    """Bands of a wide fingerprint: ``count`` times ``width`` bits of their own. Two sets meet if a band agrees, and are
    candidates if of the bits of ``COMPARED`` other words ``radius`` or fewer differ."""

    width: int
    count: int
    radius: int

    @property
    def words(self) -> int:
        """64-bit words of the fingerprint; a band lies in two of them at most, and others are compared."""
        return max(2 + COMPARED, -(-self.width * self.count // 64))

    def place(self, band: int) -> tuple[int, int]:
        return divmod(band * self.width, 64)


def bands_for(rows: int, cosine: float) -> Bands:
    """Bands that miss a pair of sets of this cosine with probability ``MISSED``, for a table of ``rows`` sets.

    A bit of two SimHashes agrees with probability 1 - angle / pi. Bands grow by a bit when the table doubles, so that
    buckets don't grow with it; there are as many as the recall asks for.
    """
    agree = min(1 - math.acos(min(cosine, 1.0)) / math.pi, 0.99)
    width = max(8, math.ceil(math.log2(max(rows, 1) / IN_BUCKET)))
    count = math.ceil(math.log(MISSED) / math.log1p(-(agree**width)))
    bits = 64 * COMPARED
    return Bands(width, count, math.ceil(bits * (1 - agree) + 4 * math.sqrt(bits * agree * (1 - agree))))


def wide_fingerprints(h: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """(sets, words) SimHashes of 64 bits a word, each from its own hash of the elements ``h[first[i]:first[i + 1]]`` of set i.

    A bit is 1 if set in over half the hashes. Bits are counted eight at a time, in the bytes of a number, over pieces of
    at most 255 elements; an empty set has zeros.
    """
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), words), np.uint64)
    if not len(some):
        return out
    pieces = -(-n[some] // 255)
    begin = np.cumsum(pieces) - pieces
    at = np.repeat(first[:-1][some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(begin, pieces))
    lanes = np.uint64(0x0101010101010101)
    bits = np.zeros((len(some), 64), bool)
    for word, seed in enumerate(mix(np.arange(1, words + 1, dtype=np.uint64) * MULTIPLIER)):
        x = mix(h ^ seed)
        for low in range(8):
            ones = np.add.reduceat((x >> np.uint64(low)) & lanes, at)
            ones = np.add.reduceat(ones.view(np.uint8).reshape(-1, 8), begin, axis=0, dtype=np.int64)
            bits[:, low::8] = 2 * ones > n[some][:, None]
        out[some, word] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def filed(prints: DataFrame, bands: Bands) -> DataFrame:
    """Rows (key, class, x0, x1, ...): each (class, print) under each of its bands, with ``COMPARED`` words of the print outside the band."""
    others = [f"x{k}" for k in range(COMPARED)]

    def run(batches):
        for batch in batches:
            data = b"".join(batch.column(1).to_pylist())
            f = np.frombuffer(data, np.uint64).reshape(batch.num_rows, bands.words)
            for band in range(bands.count):
                word, bit = bands.place(band)
                value = f[:, word] >> np.uint64(bit)
                if bit + bands.width > 64:
                    value = value | f[:, word + 1] << np.uint64(64 - bit)
                key = np.uint64(band << bands.width) | value & np.uint64((1 << bands.width) - 1)
                rest = [pa.array(f[:, (word + k) % bands.words].view(np.int64)) for k in range(2, 2 + len(others))]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), *rest], ["key", "class", *others])

    return prints.select("class", "print").mapInArrow(run, ", ".join(f"{c} bigint" for c in ["key", "class", *others]))


def bucket_links(key: int, ids: np.ndarray, others: list[np.ndarray], radius: int, light: int):
    """Arrays (place, a, b, crowded) of the members of a bucket, sorted by id, that lie within the radius.

    A member with ``light`` others near it, or fewer, gives its pairs, however many of such steps lead on from it. Members
    with more near them that such steps reach are a cluster: a light one gives all its pairs, a crowded one each member
    with the smallest.
    """
    differ = np.zeros((len(ids), len(ids)), np.int16)
    for x in others:
        x = x.view(np.uint64)  # of a negative number, numpy counts the bits of its absolute value
        differ += np.bitwise_count(x[:, None] ^ x)
    a, b = np.nonzero(np.triu(differ <= radius, 1))
    if not len(a):
        return
    busy = np.bincount(np.append(a, b), minlength=len(ids)) > light
    dense = busy[a] & busy[b]
    if dense.any():
        low = np.arange(len(ids))
        while True:
            now = low.copy()
            np.minimum.at(now, b[dense], low[a[dense]])
            np.minimum.at(now, a[dense], low[b[dense]])
            now = now[now]
            if (now == low).all():
                break
            low = now
        size = np.bincount(low, minlength=len(ids))
        member = np.flatnonzero(size[low] > light)
        if len(member):
            yield star(key, ids[low[member]], ids[member])
        alone = ~dense | (size[low[a]] <= light)
        a, b = a[alone], b[alone]
    yield np.zeros(len(a), np.int64), ids[a], ids[b], np.zeros(len(a), bool)


def star(key: int, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    place = mix(low.view(np.uint64) ^ mix(np.full(len(ids), key, np.uint64) * MULTIPLIER)).view(np.int64)
    return place, low, ids, np.ones(len(ids), bool)


def wide_links(prints: DataFrame, bands: Bands, light: int) -> DataFrame:
    """Rows (place, a, b, crowded): candidates a < b among the rows (class, print), found by bands of their wide fingerprints.

    Members of a bucket are held against one another bit by bit. Of a cluster of more than ``light`` that each have more
    than ``light`` others within the radius, and of a bucket of more than ``CROWD``, each member comes with the smallest,
    itself included, as ``crowded`` rows of one ``place``: other pairs of a place may be similar as well. Pairs come
    once for each band that finds them.
    """
    most, radius, columns = CROWD, bands.radius, 2 + COMPARED

    def whole(rows, begin, end):
        """Links of the buckets that begin and end at these rows."""
        key, ids, *others = rows
        for i, j in zip(begin.tolist(), end.tolist(), strict=True):
            if j - i > most:
                yield star(key[i], np.full(j - i, ids[i]), ids[i:j])
            elif j - i > 1:
                yield from bucket_links(key[i], ids[i:j], [x[i:j] for x in others], radius, light)

    def links(batches):
        held, crowded = [np.zeros(0, np.int64)] * columns, None  # rows of the bucket begun; key and smallest id of a crowded one
        for batch in batches:
            rows = [np.append(h, c.to_numpy(zero_copy_only=False)) for h, c in zip(held, batch.columns, strict=True)]
            if crowded:
                n = np.searchsorted(rows[0], crowded[0], "right")
                yield star(crowded[0], np.full(n, crowded[1]), rows[1][:n])
                rows = [c[n:] for c in rows]
            begin = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if len(rows[0]) else np.zeros(0, int)
            if not len(begin):
                held = rows
                continue
            yield from whole(rows, begin[:-1], begin[1:])
            held, crowded = [c[begin[-1] :] for c in rows], None
            if len(held[0]) > most:
                crowded = held[0][0], held[1][0]
                yield star(crowded[0], np.full(len(held[0]), crowded[1]), held[1])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from whole(held, np.zeros(1, int), np.full(1, len(held[0])))

    def run(batches):
        for columns in links(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "a", "b", "crowded"])

    rows = filed(prints, bands).repartition("key").sortWithinPartitions("key", "class")
    return rows.mapInArrow(run, "place bigint, a bigint, b bigint, crowded boolean")
