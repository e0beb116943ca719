"""Licence scans, sharding, mixing, decontamination and quality against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradewind.llm import decontaminate as d
from tradewind.llm import licenses, mixing, quality, sharding


def alnum_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def test_license_phrases(messy, rows, nothing):
    expected = []
    for i, text, *_ in rows:
        w = alnum_words(text)
        places = [(k, name) for p, name in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        first, last = (f(k for k, _ in places) if places else None for f in (min, max))
        expected.append((str(i), len(w), len(places), first, last, ",".join(sorted({n for _, n in places}))))
    found = licenses.license_scan(messy).collect()
    rows_found = [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(rows_found, key=str) == sorted(expected, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert licenses.license_scan(nothing).count() == 0


def test_a_phrase_of_one_word_is_found_anywhere(spark):
    texts = ["zzz unlicense qqq", "this is unlicense here", "Unlicense", "unlicensed", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = sorted(licenses.license_scan(df, phrases=[*licenses.PHRASES, ("unlicense", "unlicense")]).select("doc_id", "n_base", "first_word").collect())
    assert [tuple(r) for r in found] == [(0, 1, 1), (1, 1, 2), (2, 1, 0), (3, 0, None), (4, 0, None), (5, 0, None)]


def test_license_templates_with_gaps(spark):
    label, text = licenses.TEMPLATES[3]
    w = text.split()
    cases = {
        1: text, 2: " ".join([*w[:20], "changed", "words", *w[22:]]), 3: " ".join(w[:8]), 4: "intro " + text.upper() + " outro",
        5: " ".join(reversed(w)), 6: " ".join(["foreign"] * 40 + w[:25]),
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [found[k].labels for k in sorted(found)] == [label, label, "", label, "", label]
    assert found[1].score == 1.0 and 0.85 < found[2].score < 1 and found[3].score < 0.3
    assert (found[4].spans[0].begin, found[6].spans[0].begin) == (1, 40)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    a = licenses.Automaton()
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(8)]
    for k, t in enumerate(texts):
        a.add(k, t)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
    stream = [rng.randrange(5) for _ in range(400)]
    v = n = 0
    for i, t in enumerate(stream):
        while v > 0 and t not in a.next[v]:
            v = a.link[v]
            n = a.length[v]
        v, n = (a.next[v][t], n + 1) if t in a.next[v] else (0, 0)
        assert n == max(k for k in range(i + 2) if tuple(stream[i + 1 - k:i + 1]) in runs)


def smallest_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 40]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))]
    shards = rng.randrange(1, 9)
    starts = np.cumsum(sizes) - sizes
    cuts = [0, *sharding.cuts_of(starts, sum(sizes), shards), sum(sizes)]
    assert cuts == sorted(cuts) and set(cuts[1:-1]) <= {*starts.tolist(), sum(sizes)}
    assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) == smallest_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(messy, rows, shards, nothing):
    found = sharding.shard_evenly(messy, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(shards))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())
    total = sum(r.size for r in found)
    assert max(sum(r.size for r in x) for x in by_shard.values()) <= max(total / shards + max(r.size for r in found), 2 * total / shards)
    homes = defaultdict(set)
    for r in found:
        homes[(r.text_crc32, r.size)].add(r.shard)
    groups = Counter((t or "") for _, t, *_ in rows)
    for text, n in groups.items():
        if n * size(text) <= total / shards:
            assert len(homes[(zlib.crc32(text.encode()), size(text))]) == 1
    assert sharding.shard_evenly(nothing, shards).count() == 0


def test_a_huge_group_of_copies_is_split(spark):
    df = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"text {i} " * 12) for i in range(900)], "doc_id bigint, text string")
    found = sharding.shard_evenly(df, 10).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 300


def water_fill(sizes, weights, budget, cap):
    """Targets by a slow search of the common unit."""
    low, high = 0.0, 1e12
    for _ in range(300):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(unit * w, cap * n) for w, n in zip(weights, sizes, strict=True)) < budget else (low, unit)
    return [min(low * w, cap * n) for w, n in zip(weights, sizes, strict=True)]


def test_mixing(messy, rows, nothing):
    s = mixing.Settings(block=8, shards=5)
    words = lambda t: len((t or "").encode().split())
    per_source = Counter()
    for _, t, _, source, _ in rows:
        per_source[source] += words(t)
    order = sorted(x for x in per_source if x is not None) + [None]
    sizes = [per_source[x] for x in order]
    expected = dict(zip(order, water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2), strict=True))
    mix = mixing.mix_sources(messy, settings=s)
    found = mix.taken().collect()
    assert sorted((str(r.id), r.size) for r in found) == sorted((str(i), words(t)) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by_size = defaultdict(list)
    for (_, t, _, source, _) in rows:
        by_size[source].append(t)
    for source, n in zip(order, sizes, strict=True):
        mine = [r for r in found if r.source_size == n and abs(r.target - expected[source]) < 1e-6 * max(1, expected[source])]
        assert len(mine) >= len(by_size[source])
        if len({*sizes}) == len(sizes):
            assert abs(sum(r.taken for r in mine) - expected[source]) <= 2 * s.block
    again = mixing.mix_sources(messy.repartition(9), settings=s).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix_sources(nothing).taken().count() == 0


def test_blocks_come_once_a_round_and_shards_are_even(messy):
    mix = mixing.mix_sources(messy, settings=mixing.Settings(block=8, shards=5))
    slots = mix.slots.collect()
    assert len({(r.source_key, r.block, r.round) for r in slots}) == len(slots)
    per_shard = Counter(r.shard for r in slots)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert all(sorted(r.slot for r in slots if r.shard == k) == list(range(n)) for k, n in per_shard.items())


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(out.tolist()) == list(range(n))
    assert not np.array_equal(mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)), np.arange(1000))


def test_draws_add_up():
    s = mixing.Settings(shards=7)
    for slots in ([100, 3, 0, 57], [0, 0], [1], [5000, 4999, 1]):
        out = mixing.draws(slots, s)
        assert out.sum(axis=0).tolist() == slots and (out >= 0).all()
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 1


def test_mixed_documents_carry_the_taken_words(spark):
    rows = [(i, " ".join(f"t{i}_{k}" for k in range(5 + 13 * (i % 7))), "en", f"s{i % 3}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    s = mixing.Settings(block=16)
    out = mixing.mixed_documents(df, settings=s)
    assert out.columns == df.columns
    taken = {r.id: r.taken for r in mixing.mix_sources(df, settings=s).taken().collect()}
    found = Counter()
    for r in out.collect():
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split())
        found[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == found


def benchmark_rows(rows):
    rng = random.Random(8)
    items = []
    for k in range(25):
        w = alnum_words(rng.choice(rows)[1])
        a = rng.randrange(max(1, len(w) - 5))
        items.append((k, " ".join(w[a:a + rng.choice([1, 4, 10, 25])]).title()))
    return [*items, (90, None), (91, ""), (92, "---"), (None, "w1 w2 w3 w4 w5 w6"), items[0], (93, "absent " * 12), (94, "again " * 30)]


@pytest.mark.parametrize("block", [d.BLOCK, 400])
def test_decontaminate(spark, messy, rows, block):
    items = benchmark_rows(rows)
    windows = defaultdict(set)
    for k, text in items:
        w = alnum_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(k))
    expected = []
    for i, text, *_ in rows:
        w, hit, names = alnum_words(text), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k:k + n])] - {"None"}
        expected.append((str(i), len(w), len(hit), ",".join(sorted(names))))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.decontaminate(messy, table, block=block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in found) == sorted(expected)
    assert any(r.n_hit for r in found)


def test_decontaminate_with_nothing(spark, messy, nothing, rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in d.decontaminate(messy, none).collect()] == [0] * len(rows)
    assert d.decontaminate(nothing, none).count() == 0


def labelled(spark, n=1500, seed=2):
    rng = random.Random(seed)
    good, bad = [f"fine{i}" for i in range(40)], [f"poor{i}" for i in range(40)]
    both = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(n):
        label = i % 3 > 0
        rows.append((i, " ".join(rng.choice(both + (good if label else bad)) for _ in range(40))))
        marks.append((i, int(label if rng.random() < 0.97 else not label)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), marks


def test_quality_on_held_out_labels(spark):
    docs, marks = labelled(spark)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    out = [found[i].predicted == (i % 3 > 0) for i in found if found[i].held_out]
    assert len(out) > 300 and sum(out) / len(out) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, marks = labelled(spark, 600)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in marks]
    one, two = (
        sorted(quality.quality_scores(docs.repartition(p), spark.createDataFrame(m, "doc_id bigint, quality int")).collect())
        for p, m in ((3, marks), (5, turned))
    )
    assert one == two


def test_quality_of_odd_rows(spark, messy, rows, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (5, 1), (5, 0), (999, 1)], "doc_id bigint, quality int")
    found = quality.quality_scores(messy, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (500, 501)}) == 1
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality_scores(messy, none).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("cells", [7, 60])
def test_boundaries_of_many_groups_give_the_optimum(spark, seed, cells, monkeypatch):
    """With only some starts on the driver at once, the largest shard is what all starts allow."""
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(seed)
    sizes = [rng.choice([16, 17, 40, 400, rng.randrange(16, 3000)]) for _ in range(rng.choice([70, 300]))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes) // 4
    shards, total = rng.choice([2, 5, 11]), sum(sizes)
    starts = np.cumsum(sizes) - sizes
    atoms = spark.createDataFrame([(int(x),) for x in starts], "start bigint")
    seen = sharding.boundaries(atoms, total, max(sizes), shards)
    assert set(seen.tolist()) <= set(starts.tolist())

    def largest(cuts):
        return max(b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True))

    assert largest(sharding.cuts_of(seen, total, shards, max(sizes))) == largest(sharding.cuts_of(starts, total, shards))


def test_sharding_in_cells_is_as_even(messy, monkeypatch):
    def sizes():
        return max(sum(r.size for r in found if r.shard == k) for k in {r.shard for r in found})

    found = sharding.shard_evenly(messy, 5).collect()
    whole = sizes()
    monkeypatch.setattr(sharding, "CELLS", 12)
    found = sharding.shard_evenly(messy, 5).collect()
    assert sizes() == whole


def test_slots_unfold_in_as_many_tasks_as_the_session_has_partitions(spark, messy):
    mix = mixing.mix_sources(messy, settings=mixing.Settings(block=2))
    assert mix.slots.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("seed", range(15))
def test_draws_add_up(seed):
    rng = random.Random(seed)
    slots = [rng.choice([0, 1, 3, 50, 4000]) for _ in range(rng.randrange(1, 40))]
    out = mixing.draws(slots, mixing.Settings(shards=7, seed=seed))
    assert (out >= 0).all() and out.sum(axis=0).tolist() == slots
    assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 1


def test_an_item_of_few_words_needs_no_candidate_per_window(spark, monkeypatch):
    """A sequence of four letters: most windows have the same rarest word. Held against windows of plain strings."""
    rng = random.Random(8)
    dna = [rng.choice("acgt") for _ in range(3000)]
    texts = [" ".join(rng.choice("acgt") for _ in range(2000)), " ".join(dna[500:540]), "x " + " ".join(dna[:9]), " ".join(dna), "a c g t" * 5]
    items = [("dna", " ".join(dna)), ("short", "c g t a"), ("plain", "nothing of all this")]
    looked = []
    repeat = np.repeat
    monkeypatch.setattr(d, "STEP", 1 << 14)
    index = d.Windows(items, 10, {})
    data, offsets = d_bytes(texts)
    powers = d.Powers()
    w = d.words(data, offsets, powers, d.ALNUM, d.folded_values())
    monkeypatch.setattr(d.np, "repeat", lambda a, n, *x: looked.append(int(np.sum(n))) or repeat(a, n, *x))
    window, begin = index.find(data, w, d.Sums(w.hash, powers))
    monkeypatch.undo()
    assert max(looked) <= len(w.starts) + (1 << 14)
    windows = {t.decode() for t in index.texts}
    expected = set()
    for k, t in enumerate(texts):
        parts = alnum_words(t)
        expected |= {(int(w.first[k]) + i, " ".join(parts[i:i + n])) for n in (4, 10) for i in range(len(parts) - n + 1) if " ".join(parts[i:i + n]) in windows}
    assert {(b, index.texts[k].decode()) for k, b in zip(window.tolist(), begin.tolist(), strict=True)} == expected
    assert len(window) == len(expected)


def d_bytes(texts):
    joined = [t.encode() for t in texts]
    return np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)


def test_quality_weights_equal_a_plain_learner(spark):
    """Follow-the-regularised-leader over dictionaries, one example and one coordinate at a time."""
    import math

    import pandas as pd

    rng = random.Random(11)
    words_of = {1: ["calm", "river", "stone"], 0: ["BUY", "now", "$$$"]}
    rows = [(i, " ".join(rng.choice(words_of[i % 2] + ["and"]) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    s = quality.Settings(bits=12, epochs=3, shards=2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    found = quality.train(docs, labels, "doc_id", "text", "quality", s)
    used = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    shard = {r.id: r.p for r in spark.createDataFrame([(str(i),) for i, _ in used], "id string").selectExpr("id", "pmod(xxhash64(id), 2) AS p").collect()}
    total = defaultdict(float)
    for k in range(2):
        mine = [(i, t) for i, t in used if shard[str(i)] == k]
        mine.sort(key=lambda r: (int(pd.util.hash_array(np.array([str(r[0])], object))[0]), str(r[0])))
        labelled = Counter(i % 2 for i, _ in mine)
        weight = {y: max((labelled[1 - y] + 1) / (labelled[y] + 1), 1.0) ** s.balance for y in (0, 1)}
        z, n = defaultdict(float), defaultdict(float)

        def w_of(i, z=z, n=n):
            return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

        for _ in range(s.epochs):
            for i, t in mine:
                raw = np.frombuffer(t.encode(), np.uint8)
                _, index = quality.features(raw, np.array([0, len(raw)]), d.Powers(), s.bits)
                counted = Counter(index.tolist())
                norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counted.values())) or 1.0
                x = {0: 1.0} | {f: (1 + math.log(c)) / norm for f, c in counted.items()}
                w = {f: w_of(f) for f in x}
                p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
                for f, v in x.items():
                    g = weight[i % 2] * (p - i % 2) * v
                    z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w[f]
                    n[f] += g * g
        for f in z:
            total[f] += w_of(f) / s.shards
    expected = np.array([total.get(f, 0.0) for f in range(1 << s.bits)])
    assert np.abs(found - expected).max() < 1e-4 and np.abs(expected).max() > 0.1
