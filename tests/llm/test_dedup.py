"""Exact, line, near, substring and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tradewind.llm import seeds, simhash, substring_dedup, suffix_dedup
from tradewind.llm.exact_dedup import exact_dedup
from tradewind.llm.graph import components
from tradewind.llm.line_dedup import line_dedup


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_exact_dedup(messy, rows):
    expected = {}
    for i, text, *_ in rows:
        expected.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    found = exact_dedup(messy, hash_all=True).collect()
    assert len(found) == len(rows)
    ids = {sha(t): v for t, v in expected.items()}
    for r in found:
        own = ids[r.content_hash]
        assert (r.group_size, r.keep_id) == (len(own), min((i for i in own if i is not None), default=None))
    kept = Counter(r.content_hash for r in found if r.kept)
    assert kept == Counter({h: 1 for h in ids})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_hashes_survivors_only(messy, nothing):
    found = exact_dedup(messy).collect()
    assert all((r.content_hash is not None) or r.group_size == 1 for r in found)
    assert any(r.content_hash is None for r in found)
    assert exact_dedup(nothing).count() == 0


def test_line_dedup(messy, rows, nothing):
    sites = {}
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).add(source)
    gone = {k for k, s in sites.items() if len(s - {None}) >= 3 and re.search("[^\x20\x09-\x0d]", k)}
    assert gone
    expected = sorted((str(i), "\n".join(x for x in (t or "").split("\n") if x not in gone)) for i, t, *_ in rows)
    found = line_dedup(messy, threshold=3).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in found) == expected
    assert line_dedup(nothing).count() == 0


def test_line_dedup_near_the_threshold(spark):
    rows = [(k * 1000 + s, f"shared by {k}\nown {k} {s}", f"site{s}") for k in (38, 39, 40, 41, 44, 60) for s in range(k)]
    df = spark.createDataFrame(rows * 2, "doc_id bigint, text string, source string")
    found = {(r.doc_id // 1000, r.n_removed) for r in line_dedup(df, threshold=40).collect()}
    assert found == {(38, 0), (39, 0), (40, 1), (41, 1), (44, 1), (60, 1)}


def fingerprint(text, shingle):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    n = max(len(words) - shingle + 1, 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints):
    """The smallest of the fingerprints that links reach, by brute force."""
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in parent}


@pytest.mark.parametrize("light", [32, 1])
def test_simhash(messy, rows, light, monkeypatch):
    monkeypatch.setattr(simhash, "LIGHT", light)
    prints = [fingerprint(t, 3) for _, t, *_ in rows]
    reached = classes(prints)
    smallest = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            smallest[reached[p]] = min(i, smallest.get(reached[p], i))
    expected = sorted((str(i), f"{p:016x}", smallest.get(reached[p])) for (i, *_), p in zip(rows, prints, strict=True))
    found = simhash.simhash_dedup(messy, shingle=3).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected


@pytest.mark.parametrize("light", [32, 2])
def test_links_of_crowded_buckets(spark, light, monkeypatch):
    monkeypatch.setattr(simhash, "LIGHT", light)
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12)) for _ in range(60)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    links = simhash.near_links(df).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    groups, expected = {}, {}
    for p, c in classes(prints).items():
        expected.setdefault(c, set()).add(p)
        groups.setdefault(found.get(simhash.signed(p), simhash.signed(p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_covering_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (2000, 2001), (2001, 2000)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    expected = {i: 1 for i in range(1, 301)} | {1000 + i: 1000 for i in range(400)} | {2000: 2000, 2001: 2000}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removal(units, window):
    """Which units lie in a window that starts anywhere else too, by brute force."""
    seen = Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize(("window", "light"), [(35, 32), (35, 1), (12, 32)])
def test_substring_dedup(messy, rows, window, light, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LIGHT", light)
    units = [(t or "").encode().split() for _, t, *_ in rows]
    expected = sorted(
        (str(i), len(u), sum(g), b" ".join(w for w, x in zip(u, g, strict=True) if not x).decode())
        for (i, *_), u, g in zip(rows, units, removal(units, window), strict=True)
    )
    found = substring_dedup.substring_dedup(messy, window=window, gram=min(10, window // 2)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found) == expected
    assert any(r.n_removed for r in found)


@pytest.mark.parametrize(("window", "light"), [(200, 1024), (200, 1), (60, 1024)])
def test_suffix_dedup(messy, rows, window, light, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LIGHT", light)
    units = [(t or "").encode()[:20_000] for _, t, *_ in rows]
    from pyspark.sql import functions as F

    docs = messy.withColumn("text", F.when(F.length("text") > 20_000, F.substring("text", 1, 20_000)).otherwise(F.col("text")))
    expected = sorted(
        (str(i), len(u), sum(g), bytes(b for b, x in zip(u, g, strict=True) if not x))
        for (i, *_), u, g in zip(rows, units, removal(units, window), strict=True)
    )
    found = suffix_dedup.suffix_dedup(docs, window=window, gram=min(48, window // 3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in found) == expected
    assert all(a.high < b.low for r in found for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_nothing_in_nothing_out(nothing):
    assert simhash.simhash_dedup(nothing).count() == 0
    assert substring_dedup.substring_dedup(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_common_prefixes_of_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 3 + seed % 3, rng.integers(1, 150)).astype(np.uint8)
    if seed % 2:
        text = np.concatenate([text, text[: len(text) // 2]])
    text = np.append(text, 0).astype(np.uint8)
    for least in (9, 12, 30):
        order, cut = suffix_dedup.long_common_prefix(text, least)
        head = [text[i:i + least].tobytes().ljust(least, b"\0") for i in order]
        assert head == sorted(head) and sorted(order) == list(range(len(text)))
        full = [i + least < len(text) for i in order]
        for k in range(1, len(order)):
            if full[k] and full[k - 1]:
                assert cut[k] == (head[k] != head[k - 1])


def test_every_window_has_one_anchor_that_its_content_settles():
    rng = np.random.default_rng(5)
    s = seeds.Seeding(20, 6, 3, False)
    units = [rng.integers(0, 3, n) for n in (0, 5, 19, 20, 400, 90)] + [np.zeros(120, np.int64)]
    units[4][100:160] = units[5][10:70]
    values = seeds.byte_values()[np.concatenate(units).astype(np.uint8)]
    first = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    _, place, _, low, high = seeds.stretches(values, first, s, seeds.Powers())
    anchor = {}
    for p, a, b in zip(place, low, high, strict=True):
        for i in range(a, b + 1):
            assert i not in anchor and i <= p <= i + s.window - s.gram
            anchor[i] = p - i
    text = np.concatenate(units)
    expected = {f + i for f, u in zip(first[:-1], units, strict=True) for i in range(len(u) - s.window + 1)}
    assert set(anchor) == expected
    by_content = {}
    for i, distance in anchor.items():
        assert by_content.setdefault(text[i:i + s.window].tobytes(), distance) == distance


@pytest.mark.parametrize("light", [2, 5])
def test_crowds_around_one_passage_go_through_the_method(spark, light, monkeypatch):
    """Many texts share a passage shorter than a window, and some of them a word more to either side: level after level of finer pieces."""
    rng = random.Random(12)
    core = [f"c{i}" for i in range(20)]
    sides = [[f"s{rng.randrange(3)}" for _ in range(18)] for _ in range(12)]
    texts = []
    for _ in range(90):
        left, right = rng.choice(sides), rng.choice(sides)
        cut = rng.randrange(19)
        noise = [f"n{rng.randrange(10**6)}" for _ in range(40)]
        texts.append(" ".join([*noise[:20], *left[cut:], *core, *right[: rng.randrange(19)], *noise[20:]]))
    texts += [texts[3], " ".join(core * 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    crowds = []
    real = seeds.finer_pieces
    monkeypatch.setattr(seeds, "finer_pieces", lambda variants, s: crowds.append(s.parts) or real(variants, s))
    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "LIGHT", light)
    found = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, window=35).collect()}
    units = [t.split() for t in texts]
    gone = removal(units, 35)
    assert found == {i: (sum(g), " ".join(w for w, x in zip(u, g, strict=True) if not x)) for i, (u, g) in enumerate(zip(units, gone, strict=True))}
    assert len(crowds) > 1 and crowds == sorted(set(crowds))
    crowds.clear()
    found = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, window=100, gram=24).collect()}
    units = [t.encode() for t in texts]
    gone = removal(units, 100)
    assert found == {i: (sum(g), bytes(c for c, x in zip(u, g, strict=True) if not x)) for i, (u, g) in enumerate(zip(units, gone, strict=True))}
    assert crowds
