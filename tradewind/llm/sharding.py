"""Even shards of whole groups: the contiguous partition with the smallest largest shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import running, stored

CELLS = 1_000_000  # places at which the driver may cut that it sees at once


def cuts_of(starts: np.ndarray, total: int, shards: int, largest: int = 0) -> list[int]:
    """Where shards 1, 2, ... begin, among the ``starts`` of atomic groups that lie one after the other up to ``total``.

    Starts may be missing where no cut lies; ``largest`` is then the size of the largest group.

    The smallest feasible capacity is found by binary search; a capacity is feasible if filling each shard as far as
    it goes needs at most ``shards`` of them. Within that capacity each cut is put as near as can be to an even share of
    what is left, so that no shard is full at the price of the last. A shard is empty only if there are fewer groups.
    """
    ends = np.append(starts[1:], total)

    def reach(begin: int, capacity: int) -> int:
        """The last end of a group within ``capacity`` of ``begin``."""
        k = int(np.searchsorted(ends, begin + capacity, "right")) - 1
        return int(ends[k]) if k >= 0 else 0

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = reach(at, capacity)
            if at >= total:
                return True
        return False

    low, high = max(largest or int((ends - starts).max()), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    # From the right: the earliest start from which the shards that remain suffice.
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(int(starts[np.searchsorted(starts, earliest[-1] - low, "left")]) if earliest[-1] > 0 else 0)
    borders = np.append(starts, total)
    cuts, at = [], 0
    for k in range(1, shards):
        least, most = max(earliest[shards - k], at), reach(at, low)
        ideal = at + (total - at) / (shards - k + 1)
        i = int(np.searchsorted(borders, ideal))
        options = [int(borders[j]) for j in (i - 1, i) if 0 <= j < len(borders)]
        at = min(max(min(options, key=lambda x: abs(x - ideal)), least), most)
        cuts.append(at)
    return cuts


def walk(starts: np.ndarray, limits: np.ndarray, total: int, shards: int, capacity: int) -> list[int]:
    """How far 1, 2, ... shards of this capacity reach. A start that stands for a cell of them counts as its last possible one, ``limits``."""
    at, out = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(starts, at + capacity, "right")) - 1
        at = total if at + capacity >= total else max(at, min(at + capacity, int(limits[i]))) if i >= 0 else at
        out.append(at)
    return out


def smallest(starts: np.ndarray, limits: np.ndarray, total: int, shards: int, low: int, high: int) -> int:
    """The smallest capacity from ``low`` to ``high`` at which the last shard reaches the end."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(starts, limits, total, shards, middle)[-1] >= total else (middle + 1, high)
    return low


def boundaries(atoms: DataFrame, total: int, largest: int, shards: int) -> np.ndarray:
    """Starts of groups, among them all at which an optimal partition cuts; ``CELLS`` or fewer are fetched at once.

    Where there are more, the first start of each cell of equal length is fetched. The capacity that these starts
    allow is too large, the one found by taking every cell's last place for a start too small; between the two, each of
    the shards can only end in a window some cells wide. The starts in these windows follow, in finer cells if they
    are too many, until all of them are known: the search over the result is then the search over all starts.
    """
    if atoms.count() <= CELLS:
        return np.sort(np.asarray(atoms.distinct().toArrow().column(0)))
    low, high, windows, cell = max(largest, -(-total // shards)), total, [(0, total)], max(1, total // CELLS)
    starts = limits = np.zeros(0, np.int64)
    while True:
        near = F.lit(False)
        for a, b in windows:
            near = near | F.col("start").between(a, b)
        inside = atoms.where(near)
        exact = cell == 1 or inside.count() <= CELLS
        if not exact:
            inside = inside.groupBy((F.col("start") / cell).cast("long")).agg(F.min("start").alias("start")).select("start")
        found = np.sort(np.asarray(inside.distinct().toArrow().column(0)))
        ends = found if exact else np.minimum((found // cell + 1) * cell - 1, total)
        # Starts that are known already may be found again; the finer limit holds.
        starts, first = np.unique(np.concatenate([found, starts]), return_index=True)
        limits = np.concatenate([ends, limits])[first]
        if exact:
            return starts
        high = smallest(starts, starts, total, shards, low, high)
        low = smallest(starts, limits, total, shards, low, high)
        spans = zip(walk(starts, starts, total, shards, low), walk(starts, limits, total, shards, high), strict=True)
        windows = []
        for a, b in sorted(spans):
            if windows and a <= windows[-1][1] + 1:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))
        cell = max(1, min(cell // 2, -(-sum(b - a + 1 for a, b in windows) // CELLS)))


def shard_evenly(
    docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard`` (0 to shards - 1), ``slot`` (0, 1, ... in each).

    The size is the UTF-8 length plus ``overhead``. Rows of equal text are a group and stay together, unless they
    exceed an even share by themselves: no partition with such a group whole has shards of nearly one size, so its rows
    are then placed one by one. Groups lie in the order of their smallest ids. The largest shard is the smallest
    possible for this order; the driver sees a million group starts at once, and of more groups those near the cuts (``boundaries``).

    NULL texts equal empty ones; a NULL id comes last; rows that repeat id and text get slots of their own. Extra
    columns are ignored; an empty table gives an empty result.
    """
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(content) + overhead).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(content, 256)).alias("same"),
        )
    )
    groups = stored(rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.min("id").alias("low")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    placed = rows.join(groups.withColumnRenamed("same", "group"), F.col("same") == F.col("group")).select(
        "id", "size", "text_crc32", "same", "low", (F.col("bytes") > F.lit(total / shards)).alias("split"), F.lit(1).cast("long").alias("one")
    )
    laid = stored(running(placed, [], ["low", "same", "id"], {"start": "size", "number": "one"}))
    atoms = laid.where("not split").groupBy("same").agg(F.min("start").alias("start"), F.sum("size").alias("size")).select("start", "size")
    atoms = stored(atoms.unionAll(laid.where("split").select("start", "size")))
    largest = atoms.agg(F.max("size")).first()[0] or 0
    starts = boundaries(atoms.select("start"), int(total), int(largest), shards)
    cuts = cuts_of(starts, int(total), shards, int(largest)) if len(starts) else []
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("start"))) if cuts else F.lit(0)
    dealt = laid.withColumn("shard", shard)
    first = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.min("number").alias("n")).collect()}
    begin = F.get(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard"))
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("number") - begin).alias("slot")
    )
