import random

import pytest

CLASHING = (
    "id", "key", "row_key", "content", "size", "shard", "slot", "bucket", "near", "count", "fp", "low", "start", "copy", "label", "kept",
    "score", "site", "line", "block", "target", "taken", "spans", "n", "hash",
)
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made_up(seed, count=120):
    """Documents with copies, near copies, shared passages, licence phrases, odd white space, NULLs, and repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["MIT", "License", "Apache", "general", "public", "é", "日本", "x|y", "a b", "-"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for i in range(count):
        text = rng.choice([" ", "  ", "\n", " \t"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 40, 150])))
        if i % 4 == 1:
            text += " " + passage[rng.randrange(0, 60):]
        if i % 5 == 2 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 11 == 3 and rows:
            parts = (rng.choice(rows)[1] or "").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        rows.append((i, text, "en", f"src{min(i % 9, 3)}", len(text)))
    long = " ".join(f"w{rng.randrange(60)}" for _ in range(30_000))
    rows += [
        (500, None, None, None, None), (501, "", "", "", 0), (502, " \n\t ", "en", "src1", 4), (None, "no id w1 w2", "en", "src0", 5),
        (503, long, "en", "src0", len(long)), (504, "again " * 400, "en", "src2", 2400), (505, "one\nline\n\nmore\n", "en", "src5", 15),
    ]
    return rows + [rows[7], rows[7], rows[30], (505, "another text of the same id", "en", "src1", 27)]


@pytest.fixture(scope="session")
def rows():
    return made_up(1)


@pytest.fixture(scope="session")
def messy(spark, rows):
    """The made-up documents over several partitions, with extra columns that bear names used inside the operators."""
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    return df.selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
