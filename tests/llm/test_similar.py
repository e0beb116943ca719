"""The near-dedup stage of the pipeline against the Jaccard similarity of all pairs."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from brute import classes

from tradewind.llm import similar

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def copies(seed=5):
    """Documents of 300 to 700 words, and copies with 1 to 60 replaced words."""
    rng, out = random.Random(seed), []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(300, 700))]
        out.append(words)
        for replaced in (1, 2, 5, 7, 10, 14, 20, 60):
            copy = list(words)
            for i in rng.sample(range(len(copy)), replaced):
                copy[i] = f"x{rng.randrange(3000)}"
            out.append(copy)
    return [" ".join(w) for w in out]


def crowd(count=150, seed=6):
    """Many documents around one passage: some linked through others only, some not at all."""
    rng = random.Random(seed)
    core = [f"w{i}" for i in range(60)]
    out = []
    for k in range(count):
        words = list(core)
        for _ in range(1 if k % 3 else 2):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        if k % 10 == 0:
            words += [f"y{rng.randrange(10**6)}" for _ in range(15)]
        out.append(" ".join(words))
    return out


def passage(count=200, seed=7):
    """Documents that share a passage of two thirds of their words, so that bands are crowded, and some near copies of them."""
    rng = random.Random(seed)
    core = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(count):
        own = [f"x{rng.randrange(10**6)}" for _ in range(100)]
        out.append(own[:50] + core + own[50:])
        if rng.random() < 0.2:
            out.append([*own[:50], *core, *own[50:90], *(f"z{rng.randrange(10**6)}" for _ in range(10))])
    return [" ".join(w) for w in out]


def kept(spark, texts):
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    found = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS).repartition(5), "").collect()
    return sorted(r.doc_id for r in found)


def test_copies_of_similarity_08_go_and_no_others(spark):
    texts = copies()
    expected = classes(texts)
    assert 25 < len(set(expected)) < len(texts)
    assert kept(spark, texts) == sorted(set(expected))


@pytest.mark.parametrize(("light", "block"), [(32, 256), (4, 16), (100_000, 256)])
def test_crowded_buckets_lose_no_link(spark, light, block, monkeypatch):
    monkeypatch.setattr(similar, "LIGHT", light)
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = crowd()
    assert kept(spark, texts) == sorted(set(classes(texts)))


@pytest.mark.parametrize("light", [4, 32])
def test_a_common_passage_needs_no_blocks(spark, light, monkeypatch):
    monkeypatch.setattr(similar, "LIGHT", light)
    monkeypatch.setattr(similar, "meetings", lambda open_: pytest.fail("blocks met"))
    texts = passage()
    expected = sorted(set(classes(texts)))
    assert len(expected) == 200 < len(texts)
    assert kept(spark, texts) == expected


def test_prefixes_are_those_of_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIGHT", 4)
    rng = random.Random(8)
    common = [rng.randrange(-(2**63), 2**63) for _ in range(12)]
    sets = {}
    for k in range(60):
        own = [rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(1, 9))]
        sets[k] = sorted({*own, *rng.sample(common, rng.randrange(0, 13)), *(rng.choice(list(sets.values())) if k % 3 == 1 else [])})
    members = spark.createDataFrame([(k, k % 7, s) for k, s in sets.items()], "class bigint, comp bigint, hashes array<bigint>").repartition(4)
    count = Counter(h for s in sets.values() for h in s)
    assert {r.band: r["count"] for r in similar.held_by_several(members).collect()} == {h: n for h, n in count.items() if n > 1}
    expected = set()
    for k, s in sets.items():
        order = sorted(s, key=lambda h: ((count[h] > 1) + (count[h] > 4), h))
        first = order[: len(s) - -(-len(s) * 8 // 10) + 1]
        expected |= {(h, k, len(s), k % 7) for h in first if count[h] > 1}
    assert {tuple(r) for r in similar.prefixes(members, 8).collect()} == expected
    assert similar.prefixes(members.limit(0), 8).count() == 0


def test_the_largest_component_does_not_meet_itself(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 10)

    def blocks(count):
        rows = [(1, k, 0, 0 if k < count - 5 else k) for k in range(count)]
        parts = similar.meetings(spark.createDataFrame(rows, "band bigint, class bigint, low bigint, comp bigint")).collect()
        met = {frozenset((a["class"], b["class"])) for a in parts for b in parts if (a.i, a.j) == (b.i, b.j) and a.comp != b.comp}
        assert len(met) == 5 * (count - 5) + 10
        return len(parts)

    assert blocks(400) <= 4 * blocks(100) + 40


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_row_of_the_given_documents(spark, size):
    path = f"/root/testdata/{size}"
    docs = pipeline.table(spark, path, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    reached = classes([t for _, t in rows])
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, path).collect()) == sorted({rows[k][0] for k in reached})


def test_columns_may_bear_any_names(spark):
    texts = ["a b c d e f g", "a b c d e f g", "one two three four five six", None, ""]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1, texts[1], "x"), (None, texts[0], "y")]
    df = spark.createDataFrame(rows, "id bigint, content string, component string")
    kept_ids = sorted(r.id for r in similar.one_of_each(df, "id", "content").collect())
    assert kept_ids == [0, 2, 3]
