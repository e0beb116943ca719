"""Words of whole Arrow batches as numpy arrays: boundaries, 64-bit hashes and hashes of word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text that are worked on at once; a longer text is a chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words are runs of anything but ASCII white space.
VISIBLE = ~SPACE
#: Words are runs of ASCII letters and digits and of all bytes above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A random number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


class Powers:
    """Powers of the odd multiplier and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), CHUNK // 2 + 1)
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            self.up, self.down = (np.full(size, m, np.uint64) for m in (MULTIPLIER, inverse))
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


class Sums:
    """Prefix sums of values[i] * multiplier**i: the hash of any run of values at a constant price."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins and ends. NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1, first + 10_000)
        yield first, last
        first = last


@dataclass
class Words:
    """The words of a chunk of texts; ``first[d]`` to ``first[d + 1]`` are those of text d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, powers: Powers, allowed: np.ndarray, values: np.ndarray) -> Words:
    """Maximal runs of the bytes ``allowed`` within each text. ``values``: a number for each byte, for the hashes."""
    is_word = allowed[data]
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    start[border] = is_word[border]
    end[border - 1] = is_word[border - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), Sums(values[data], powers).hash(starts, ends))


def sequences(w: Words, k: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``k`` consecutive words of one text begin, and the hashes of these words."""
    per_doc = np.maximum(np.diff(w.first) - k + 1, 0)
    total = int(per_doc.sum())
    skipped = np.repeat(w.first[:-1] - (np.cumsum(per_doc) - per_doc), per_doc)
    at = np.arange(total) + skipped
    return at, Sums(w.hash, powers).hash(at, at + k)


def documents(batches, text: str = "content"):
    """(batch, bytes, offsets, first row, last row) of each chunk of Arrow batches; the bytes and offsets are the chunk's own."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in chunks(offsets):
            yield batch, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j
