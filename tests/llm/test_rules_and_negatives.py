"""Quality rules and hard negatives against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tradewind.llm import negatives, quality_rules, registry

DIRECTORY = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def counts(text):
    text = text or ""
    w = [x for x in re.split(SPACE, text) if x]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.sub(SPACE, "", line)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, messy, rows, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = [(900, "a\n\na\n a\na\n\n\n", "", "", 0), (901, "one two three one two three", "", "", 0), (902, "#*$%&|<> é日本 x y", "", "", 0), (903, "x\r\nx\r\nx", "", "", 0)]
    df = messy.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(odd, messy.select("doc_id", "text", "lang", "source", "n_chars").schema))
    found = quality_rules.quality_rules(df.selectExpr("*", "1 AS shares", "'' AS score", "'' AS label"), labels).collect()
    told = sorted((str(r.doc_id), *r[1:6], r.base_failed, r.kept) for r in found)
    expected = []
    for i, text, *_ in rows + odd:
        c = counts(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        expected.append((str(i), *c, failed, not failed))
    assert told == sorted(expected)
    assert quality_rules.quality_rules(nothing, labels).count() == 0


def test_labels_set_the_threshold(spark):
    docs = registry.table(spark, DIRECTORY, "documents")
    labels = registry.table(spark, DIRECTORY, "labels")
    label = {r.doc_id: r.quality for r in labels.collect()}
    found = registry.op12_quality_rules(spark, DIRECTORY).collect()
    passed = [r for r in found if not r.base_failed and r.doc_id in label]
    good, bad = ([r.kept for r in passed if label[r.doc_id] == q] for q in (1, 0))
    assert len(found) == docs.count() and not any(r.kept for r in found if r.base_failed)
    assert all(good) and bad and not any(bad)
    again = {r.doc_id: r.score for r in quality_rules.quality_rules(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {r.doc_id: r.score for r in found}


def test_odd_labels(spark, messy):
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (5, 0), (5, 1), (5, 1), (503, 1), (9, 1), (30, 1), (77_777, 1)], "doc_id bigint, quality int")
    found = quality_rules.quality_rules(messy, odd).collect()
    assert len(found) == messy.count() and all(0 <= r.score <= 1 for r in found)


def walk(forest, row):
    """Mean path length, node by node."""
    total = 0.0
    for tree in range(len(forest.split)):
        node = 0
        while forest.left[tree, node] != node:
            side = forest.left if row[forest.feature[tree, node]] < forest.split[tree, node] else forest.right
            node = side[tree, node]
        total += forest.length[tree, node]
    return total / len(forest.split)


def test_forest_scores_are_path_lengths():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(0.3, 0.02, (400, 3)), [[0.9, 0.3, 0.3]]])
    s = quality_rules.Settings(trees=20)
    forest = quality_rules.Forest(rows[:400], rows.min(0), rows.max(0) + 1e-9, s)
    scores = forest.score(rows)
    assert scores.argmax() == 400
    expected = [2 ** (-walk(forest, r) / float(quality_rules.usual_depth(256))) for r in rows[:20]]
    assert np.allclose(scores[:20], expected)
    same = quality_rules.Forest(np.ones((5, 2)), np.ones(2), np.ones(2), s)  # nothing to split on
    assert len(set(same.score(np.ones((3, 2))))) == 1


@pytest.mark.parametrize("seed", range(20))
def test_threshold_is_the_best(seed):
    rng = random.Random(seed)
    good, bad = (np.array([rng.choice([0, 0, 1, 30]) for _ in range(12)]) for _ in range(2))
    t = quality_rules.threshold_of(good, bad, 0.05)
    allowed = [k for k in range(13) if good[k:].sum() <= 0.05 * good.sum()]
    assert t in allowed and bad[t:].sum() == max(bad[k:].sum() for k in allowed)


@pytest.mark.parametrize(("m", "k", "n"), [(1, 1, 1), (5, 64, 7), (33, 65, 129), (70, 0, 3), (0, 4, 4)])
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_strassen_is_exact(m, k, n, leaf):
    rng = np.random.default_rng(m + k + n)
    a, b = rng.integers(-2**62, 2**62, (m, k)), rng.integers(-2**62, 2**62, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()  # both modulo 2**64


def mined(rows, positives=5, k=5):
    import math

    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: [math.floor(256 * x) for x in v] for i, (_, v) in kept.items()}
    out = []
    for a in kept:
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(whole[a], whole[i], strict=False)) for i in kept if i != a}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if kept[i][0] == kept[a][0]][:positives]:
            s = scores[p]
            hard = [i for i in ranked if kept[i][0] != kept[a][0] and 80 * s <= 100 * scores[i] <= 100 * s]
            out += [(a, p, r, i, s, scores[i]) for r, i in enumerate(hard[:k], 1)]
    return sorted(out)


def vectors(seed, n=700):
    rng = random.Random(seed)
    common = [rng.choice([-1.0, 0.5, 1.0]) for _ in range(6)]
    rows = []
    for i in range(n):
        v = list(common) if i % 3 == 0 else [round(rng.gauss(0.4, 0.5), rng.choice([1, 5])) for _ in range(rng.choice([6, 6, 6, 4, 9]))]
        rows.append((i, v, 2 if i % 3 == 0 else rng.randrange(10)))
    rows += [(701, None, 1), (702, [0.1], None), (703, [None, 1.0], 1), (704, [float("nan")], 1), (705, [float("inf")], 1), (None, [1.0], 1), (800, [], 3)]
    return [*rows, rows[5], rows[100], (200, [9.0, 9.0], 5), (201, [9.0], 1)]


@pytest.mark.parametrize("block", [16 << 20, 3_000])
def test_hard_negatives_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "LEAF", 2)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    df.selectExpr("*", "1 AS id", "'' AS vector", "1 AS rank", "1 AS anchor_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [tuple(r) for r in registry.op13_hard_negatives(spark, str(tmp_path)).collect()]
    assert sorted(found) == mined(rows)


def test_no_anchors(spark, tmp_path):
    for name, rows in (("none", []), ("no_anchor", [(1, [1.0], 1), (2, [1.0], 2)]), ("alone", [(100, [1.0], 1)])):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert registry.op13_hard_negatives(spark, f"{tmp_path}/{name}").collect() == []


@pytest.mark.parametrize("seed", range(10))
def test_heaps_merge_in_any_order(seed):
    rng = np.random.default_rng(seed)
    heap, score, ident = rng.integers(0, 4, 200), rng.integers(-3, 4, 200), rng.permutation(200)
    heaps = negatives.Heaps(4, 5)
    for part in np.array_split(np.arange(200), 9):
        heaps.push(heap[part], score[part], ident[part])
    for h in range(4):
        best = sorted((-s, i) for g, s, i in zip(heap, score, ident, strict=True) if g == h)[:5]
        assert [(-s, i) for g, s, i in zip(*heaps.all(), strict=True) if g == h] == best
