"""The near-dedup stage of the pipeline finds its candidates by SimHash, and misses none."""

import random

import corpus_pipeline as pipeline
import numpy as np
import pytest
from brute import classes
from test_similar import crowd, kept, passage

from tradewind.llm import simhash, similar
from tradewind.llm.words import MULTIPLIER, mix


def sets(seed=3, sizes=(0, 1, 2, 5, 254, 255, 256, 700)):
    rng = random.Random(seed)
    return [np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in sizes]


def prints(some, words):
    return simhash.wide_fingerprints(np.concatenate(some), np.append(0, np.cumsum([len(s) for s in some])), words)


def test_a_bit_is_set_if_over_half_of_the_hashes_have_it():
    some = sets()
    found = prints(some, 3)
    for word, seed in enumerate(mix(np.arange(1, 4, dtype=np.uint64) * MULTIPLIER)):
        for s, f in zip(some, found[:, word].tolist(), strict=True):
            hashes = mix(s ^ seed).tolist()
            assert f == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def pairs_at_the_border(count=400, seed=4):
    """Pairs of sets of similarity 0.8 or just above, of 4 to 400 elements."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        common = 4 * rng.choice([1, 2, 3, 10, 50, 80])
        own = rng.randrange(common // 4 + 1)
        c, a, b = (np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in (common, own, common // 4 - own))
        out += [np.concatenate([c, a]), np.concatenate([c, b])]
    return out


@pytest.mark.parametrize(("rows", "most"), [(1, 2048), (10**6, 2048), (1, 2)])
def test_bands_find_all_pairs_of_similarity_08(spark, rows, most, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", most)
    bands = simhash.bands_for(rows, 1.6 / 1.8)
    some = pairs_at_the_border()
    table = [(k, bytearray(f.tobytes())) for k, f in enumerate(prints(some, bands.words))]
    df = spark.createDataFrame(table, "class bigint, print binary").repartition(5)
    found = simhash.wide_links(df, bands, 32).collect()
    places = {}
    for r in found:
        places.setdefault((r.place if r.crowded else 0, r.a), set()).add(r.b)
    of_place = [{*members, low} for (place, low), members in places.items() if place]
    links = {(r.a, r.b) for r in found if not r.crowded}
    assert all((k, k + 1) in links or any({k, k + 1} <= p for p in of_place) for k in range(0, len(some), 2))
    assert bool(of_place) == (most == 2)
    if most > 2:
        assert len(links) < 1.1 * len(some) / 2
    assert simhash.wide_links(df.limit(0), bands, 32).count() == 0


def test_members_of_a_crowded_bucket_come_with_its_smallest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        bands = simhash.bands_for(1, 1.6 / 1.8)
        df = spark.createDataFrame([(k, bytearray(8 * bands.words)) for k in range(50)], "class bigint, print binary").repartition(3)
        found = simhash.wide_links(df, bands, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r.place for r in found}) == bands.count
    assert sorted((r.a, r.b) for r in found) == sorted((0, k) for k in range(50) for _ in range(bands.count))
    assert all(r.crowded for r in found)


def near(spark, others, radius, light):
    """Links of one bucket whose members differ in ``others``, the words compared: pairs, and the members of each place."""
    bands = simhash.Bands(8, 1, radius)
    rows = [(k, bytearray(np.array([0, 0, *x, *[0] * (bands.words - 2 - len(x))], np.uint64).tobytes())) for k, x in enumerate(others)]
    found = simhash.wide_links(spark.createDataFrame(rows, "class bigint, print binary").repartition(3), bands, light).collect()
    places = {}
    for r in found:
        if r.crowded:
            places.setdefault(r.place, set()).update((r.a, r.b))
    return sorted((r.a, r.b) for r in found if not r.crowded), list(places.values())


def test_a_long_chain_is_no_crowd(spark):
    pairs, places = near(spark, [[(1 << k) - 1] for k in range(60)], 1, 4)
    assert pairs == [(k, k + 1) for k in range(59)] and not places


@pytest.mark.parametrize("light", [1, 4, 10, 80])
def test_a_near_pair_is_given_or_of_one_place(spark, light):
    rng = random.Random(light)
    others = [[rng.getrandbits(3) | (rng.getrandbits(12) << 3 if k % 2 else 0), rng.getrandbits(1) << 63] for k in range(120)]
    pairs, places = near(spark, others, 2, light)
    close = {
        (a, b) for b in range(120) for a in range(b) if sum((x ^ y).bit_count() for x, y in zip(others[a], others[b], strict=True)) <= 2
    }
    beside = [sum(k in p for p in close) for k in range(120)]
    assert set(pairs) <= close and all(p in pairs or any({*p} <= c for c in places) for p in close)
    assert all(len(c) > light and all(beside[k] > light for k in c) for c in places) and bool(places) == (light < 80)
    assert len(pairs) == len(set(pairs)) <= 120 * light


def test_all_words_compared_count(spark):
    every = 2**64 - 1
    pairs, places = near(spark, [[0, 0], [every, every], [1, 3], [7, 0]], 3, 4)
    assert pairs == [(0, 2), (0, 3)] and not places


def test_bands_grow_with_the_table():
    small, large = (simhash.bands_for(n, 1.6 / 1.8) for n in (10**5, 10**8))
    assert large.width == small.width + 10 and large.count > small.count and large.radius == small.radius < 64
    assert simhash.bands_for(0, 1.0).count >= 1


@pytest.mark.parametrize("texts", [crowd(), passage()])
def test_crowded_simhash_buckets_lose_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 20)
    monkeypatch.setattr(similar, "LIGHT", 4)
    assert kept(spark, texts) == sorted(set(classes(texts)))


def test_the_stage_links_what_simhash_brings_together(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words)]
    assert kept(spark, texts) == [0]
    found = simhash.bands_for(len(texts), 1.6 / 1.8)
    monkeypatch.setattr(similar, "bands_for", lambda rows, cosine: simhash.Bands(found.width, found.count, -1))
    assert kept(spark, texts) == [0, 1]
    assert dict(pipeline.STAGES)["simhash near-dedup"] is pipeline.drop_near_copies
