"""Groups of documents whose sets of word shingles are similar: SimHash bands find candidates, exact sets decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.graph import components
from tradewind.llm.simhash import Bands, bands_for, wide_fingerprints, wide_links
from tradewind.llm.store import bound_batches, may_contain, membership, stored
from tradewind.llm.words import LOWER, MULTIPLIER, VISIBLE, Powers, Sums, byte_values, documents, mix, words

LIGHT = 32  # classes in a bucket that are compared with one another at once
BLOCK = 256  # classes of a crowded group that go to a task together
BITS = 1 << 25  # of the bitmap that spares the second pass most texts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and where each begins and ends.

    Words are lower-cased runs of anything but ASCII white space. A text of fewer words is one shingle, one without
    words has none.
    """
    w = words(data, offsets, powers, VISIBLE, byte_values()[LOWER])
    n = np.diff(w.first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][doc]
    h = Sums(w.hash, powers).hash(at, np.minimum(at + shingle, w.first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def class_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number that texts of the same shingle set share."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ MULTIPLIER), dtype=np.uint64)])
    return mix((sums[first[1:]] - sums[first[:-1]]) + mix(np.diff(first).astype(np.uint64))).view(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """(id, key, class, n, print) for each row (id, key, content); the print is the SimHash of the distinct shingles."""
    words = bands.words

    def run(batches):
        powers = Powers()
        for batch, data, offsets, i, j in documents(batches):
            h, first = shingle_sets(data, offsets, shingle, powers)
            prints = pa.array([f.tobytes() for f in wide_fingerprints(h, first, words)], pa.binary())
            columns = [batch.column(c).slice(i, j - i) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(class_of(h, first)), pa.array(np.diff(first), pa.int64()), prints], ["id", "key", "class", "n", "print"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "content").mapInArrow(run, f"id {kind}, key bigint, class bigint, n bigint, print binary")


def sets(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(class, hashes) of the rows whose ``key`` is among ``keys``, once for each class."""
    likely = may_contain(docs, F.col("key"), stored(membership(keys, F.col("key"), BITS)), BITS, "likely").where("likely")
    rows = likely.join(keys.hint("shuffle_hash"), "key", "left_semi").select("content")

    def run(batches):
        powers = Powers()
        for _, data, offsets, _, _ in documents(batches):
            h, first = shingle_sets(data, offsets, shingle, powers)
            yield pa.RecordBatch.from_arrays([pa.array(class_of(h, first)), lists(h, first)], ["class", "hashes"])

    return rows.mapInArrow(run, "class bigint, hashes array<bigint>").dropDuplicates(["class"])


def similar(common: Column, n_a: Column, n_b: Column, tenths: int) -> Column:
    """Whether common / (n_a + n_b - common) is at least tenths / 10, in whole numbers."""
    return common * (10 + tenths) >= (n_a + n_b) * tenths


def verified(pairs: DataFrame, known: DataFrame, tenths: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets are similar."""
    one, two = (known.select(F.col("class").alias(c), F.col("hashes").alias(f"h_{c}")) for c in ("a", "b"))
    both = pairs.join(one.hint("shuffle_hash"), "a").join(two.hint("shuffle_hash"), "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return both.where(similar(common, F.size("h_a"), F.size("h_b"), tenths)).select("a", "b")


def block_links(part: pd.DataFrame, tenths: int) -> pd.DataFrame:
    """Links between the two blocks of a part (one block: within it) of classes that earlier links don't join."""
    part = part.drop_duplicates("class")
    h = np.concatenate(part["hashes"].to_numpy()).astype(np.int64)
    n = part["hashes"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(part)), n)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    common = np.zeros((len(part), len(part)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(names), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        has = np.zeros((len(part), 4096), np.float32)
        has[row[i:j], column[i:j] - low] = 1
        common += has @ has.T
    comp, block = part["comp"].to_numpy(), part["block"].to_numpy()
    apart = (comp[:, None] != comp[None, :]) & ((block[:, None] != block[None, :]) | (part["i"].iloc[0] == part["j"].iloc[0]))
    a, b = np.nonzero(np.triu((common * (10 + tenths) >= (n[:, None] + n[None, :]) * tenths) & apart, 1))
    ids = part["class"].to_numpy()
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def open_buckets(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (band, class, low) of buckets that reach several components of the links ``found``, with their ``comp``."""
    comps = stored(components(found)).select(F.col("node").alias("class"), "component")
    named = stored(buckets.join(comps, "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component"))
    split = named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    return stored(named.join(split, "band", "left_semi"))


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (band, class, n, comp) of bands that several rows share, with ``members``, and ``low``, the smallest class, and its comp."""
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("low"), F.min_by("comp", "class").alias("low_comp"))
    return stored(rows.join(stored(sizes.where("members > 1")).hint("shuffle_hash"), "band"))


def candidates(full: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b) of different components: all of a light bucket that sizes allow, and each of a crowded one with its ``low``."""
    light = full.where(F.col("members") <= LIGHT)
    one, two = (light.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "comp")]) for x in "ab")
    pairs = (
        one.join(two, "band")
        .where((F.col("class_a") < F.col("class_b")) & (F.col("comp_a") != F.col("comp_b")))
        .where(similar(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"), tenths))
        .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    )
    stars = full.where((F.col("members") > LIGHT) & (F.col("comp") != F.col("low_comp")))
    return stored(pairs.unionAll(stars.select(F.col("low").alias("a"), F.col("class").alias("b"))).distinct())


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of ``column`` one after the other, and where each list begins and ends."""
    first = np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first


def held_by_several(members: DataFrame) -> DataFrame:
    """(band, count) of the shingles that several members hold; what a batch of them holds is added up before it is shuffled."""

    def run(batches):
        for batch in batches:
            band, held = np.unique(list_values(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(held, pa.int64())], ["band", "held"])

    held = members.select("hashes").mapInArrow(run, "band bigint, held bigint")
    return held.groupBy("band").agg(F.sum("held").alias("count")).where("count > 1")


def packed(keys: DataFrame) -> np.ndarray:
    """The bitmap of ``membership`` of the column ``band`` in one piece: BITS / 8 bytes (4 MB) for any input."""
    out = np.zeros(BITS // 8, np.uint8)
    for r in membership(keys, F.col("band"), BITS).collect():
        piece = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        at = (r["bucket"] - 1) * len(piece)
        out[at : at + len(piece)] = piece
    return out


def among(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """1 for each hash that may be a member of ``bitmap``, 0 for those that surely aren't."""
    at = h & np.int64(8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def prefixes(members: DataFrame, tenths: int) -> DataFrame:
    """Rows (band, class, n, comp): of each set, the shingles of which two similar sets share one.

    Sets that are similar have at least tenths / 10 of each in common, so that in any order of all shingles they share
    one of the first n - ceil(n * tenths / 10) + 1. The order takes shingles of one member first, crowded ones last; two
    bitmaps of bounded size hold which are which. A bit that another shingle set only changes the order, for all alike.
    Sets stay whole until their prefix is cut: only its shared shingles become rows.
    """
    counts = stored(held_by_several(members))
    bitmaps = members.sparkSession.sparkContext.broadcast((packed(counts), packed(counts.where(F.col("count") > LIGHT))))

    def run(batches):
        several, crowded = bitmaps.value
        for batch in batches:
            h, first = list_values(batch.column(2))
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            shared = among(h, several)
            order = np.lexsort((h, shared + among(h, crowded), row))
            place = np.arange(len(h)) - first[row]
            at = order[(place < (n + (-n * tenths) // 10 + 1)[row]) & (shared[order] == 1)]
            rows = pa.array(row[at])
            columns = [pa.array(h[at]), batch.column(0).take(rows), pa.array(n[row[at]]), batch.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, ["band", "class", "n", "comp"])

    return members.select("class", "comp", "hashes").mapInArrow(run, "band bigint, class bigint, n bigint, comp bigint")


def meetings(open_: DataFrame) -> DataFrame:
    """Rows (group, i, j, block, class, comp): which blocks of classes meet, for the rows (band, class, low, comp) of open buckets.

    Buckets that share classes are one group, cut into blocks. Those of its largest component needn't meet one another.
    """
    links = open_.select(F.col("class").alias("a"), F.col("low").alias("b"))
    groups = stored(components(links)).select(F.col("node").alias("class"), F.col("component").alias("group"))
    members = stored(open_.select("class", "comp").distinct().join(groups, "class"))
    sizes = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("count"))
    sizes = sizes.groupBy("group").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all")
    )
    sizes = sizes.select("group", "main", F.ceil(F.col("most") / BLOCK).alias("m"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("r"))
    rest, at = F.col("comp") != F.col("main"), F.xxhash64("class")
    dealt = members.join(stored(sizes), "group").withColumn(
        "block", F.when(rest, F.pmod(at, F.col("r"))).otherwise(F.col("r") + F.pmod(at, F.col("m"))).cast("int")
    )
    others = F.sequence(F.lit(0), (F.when(rest, F.col("r") + F.col("m")).otherwise(F.col("r")) - 1).cast("int"))
    meet = F.transform(others, lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return dealt.where("r > 0").withColumn("meet", F.explode(meet)).select("group", "meet.i", "meet.j", "block", "class", "comp")


def crowded_links(crowded: DataFrame, found: DataFrame, known: DataFrame, tenths: int) -> DataFrame:
    """The links that crowded buckets (band, class, low) hold beside those ``found``, as far as they join components.

    Buckets within one component need nothing. The members of the others are joined by the prefixes of their sets, which
    part what only a common passage brought together. Members of prefixes that are crowded as well are held against the
    smallest; if these still reach several components, their blocks meet in tasks of their own, where all pairs of
    different components are compared. A class is sent once for each block that it meets, not for each pair.
    """
    comps = open_buckets(crowded, found).select("class", "comp").distinct()
    members = stored(known.join(comps, "class"))
    full = bucketed(prefixes(members, tenths))
    links = stored(verified(candidates(full, tenths), members, tenths))
    left = open_buckets(full.where(F.col("members") > LIGHT).select("band", "class", "low"), found.unionAll(links))
    if left.isEmpty():
        return links
    parts = meetings(left).join(members.select("class", "hashes").hint("shuffle_hash"), "class")
    return links.unionAll(parts.groupBy("group", "i", "j").applyInPandas(lambda part: block_links(part, tenths), "a bigint, b bigint"))


def similar_groups(docs: DataFrame, id_col: str, text_col: str, key_col: str, shingle: int = 5, tenths: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, key, ``component``, a number shared by all documents that links reach.

    Documents are linked if the Jaccard similarity of their sets of shingles is ``tenths`` / 10 or more: each
    candidate's sets are compared. Texts of equal sets are one class from the start. Candidates are found by SimHash:
    bands of wide fingerprints, whose width follows the number of rows, and the bits that differ beside them
    (``simhash.wide_links``). Crowded clusters are first held against their smallest class; where that leaves several
    components, ``crowded_links`` compares their members.

    Shingles stand as 64-bit hashes. ``key`` is a hash of id and text. NULL texts and those without words are a class.
    Rows that repeat id and text each get a row of the result; ids may repeat or be NULL. A long text counts whole; its set has to fit
    a row. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("content"))
    bands = bands_for(base.count(), 2 * tenths / (10 + tenths))  # the least cosine of sets so similar
    prints = stored(signatures(base, shingle, bands))
    rows = prints.select("id", "key", "class")
    classes = stored(prints.where("n > 0").groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("print").alias("print")))
    # Of fewer shingles, sets that aren't equal can't be similar.
    found = stored(wide_links(classes.where(F.col("n") * (10 - tenths) >= tenths), bands, LIGHT))
    pairs = stored(found.where("a <> b").select("a", "b").distinct())
    crowded = found.where("crowded").select(F.col("place").alias("band"), F.col("b").alias("class"), F.col("a").alias("low"))
    needed = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    keys = stored(classes.select("class", "key").join(needed, "class", "left_semi").select("key"))
    known = stored(sets(base, keys, shingle))
    links = stored(verified(pairs, known, tenths))
    if not crowded.isEmpty():
        links = stored(links.unionAll(crowded_links(crowded, links, known, tenths)))
    comps = components(links).select(F.col("node").alias("class"), "component")
    return rows.join(stored(comps), "class", "left").select(
        F.col("id").alias(id_col), F.col("key").alias(key_col), F.coalesce("component", "class").alias("component")
    )


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and ``row_key`` aren't in ``gone`` (id, row_key)."""
    gone = gone.select(F.col(id_col).alias("id_of_gone"), F.col("row_key").alias("key_of_gone")).hint("shuffle_hash")
    same = docs[id_col].eqNullSafe(F.col("id_of_gone")) & (row_key(id_col, text_col) == F.col("key_of_gone"))
    return docs.join(gone, same, "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """The rows of ``docs`` with all their columns, of each group of ``similar_groups`` only the one with the smallest id.

    A NULL id comes after all others; of rows with the smallest id, the text with the smallest hash stays, and of rows
    that repeat id and text, one. NULL texts and those without words are one group. An empty table stays empty.
    """
    base = docs.select(F.col(id_col), F.col(text_col), row_key(id_col, text_col).alias("row_key"))
    found = stored(similar_groups(base, id_col, text_col, "row_key", shingle, tenths))
    best = found.groupBy("component").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "row_key")).alias("best")
    )
    best = stored(best.select(F.col("component").alias("of_best"), F.col("best.id").alias("id_of_best"), F.col("best.row_key").alias("key_of_best")))
    rows = found.join(best, F.col("component") == F.col("of_best"))
    stays = F.col(id_col).eqNullSafe(F.col("id_of_best")) & (F.col("row_key") == F.col("key_of_best"))
    left = without(docs, rows.where(~stays).select(id_col, "row_key"), id_col, text_col)
    repeated = stored(found.groupBy(id_col, "row_key").count().where("count > 1").select(id_col, "row_key"))
    if repeated.isEmpty():
        return left
    twice = repeated.select(F.col(id_col).alias("id_of_twice"), F.col("row_key").alias("key_of_twice"))
    same = left[id_col].eqNullSafe(F.col("id_of_twice")) & (row_key(id_col, text_col) == F.col("key_of_twice"))
    again = left.join(twice, same, "left_semi")
    return without(left, repeated, id_col, text_col).unionAll(again.dropDuplicates([id_col, text_col]))
