"""The stages of the corpus pipeline: each against what its operator says of its own input."""

import corpus_pipeline as pipeline
import pytest
from brute import classes

from tradewind.llm.decontaminate import decontaminate
from tradewind.llm.mixing import mix_sources
from tradewind.llm.quality import quality_scores
from tradewind.llm.store import stored

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = pipeline.table(spark, DIRECTORY, "documents")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, DIRECTORY))
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order():
    assert [n.split()[0] for n, _ in pipeline.STAGES] == ["quality", "simhash", "benchmark", "mixing", "sharding"]


def test_all_but_the_last_keep_the_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert all(df.dtypes == steps[0].dtypes for df in steps[:-1])


def test_the_classifier_decides(spark, steps):
    scores = quality_scores(steps[0], pipeline.table(spark, DIRECTORY, "labels")).where("score >= 0.5")
    assert ids(scores) == ids(steps[1])


def test_one_of_each_group_stays(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[1].collect())
    reached = classes([t for _, t in rows])
    assert ids(steps[2]) == sorted({rows[k][0] for k in reached})
    assert len(set(reached)) < len(rows)


def test_contaminated_documents_go(spark, steps):
    found = decontaminate(steps[2], pipeline.table(spark, DIRECTORY, "benchmark")).collect()
    assert ids(steps[3]) == sorted(r.doc_id for r in found if not r.n_hit)
    assert any(r.n_hit for r in found)


def test_the_mix_takes_what_it_says(steps):
    taken = sum(r.taken for r in mix_sources(steps[3]).taken().collect())
    words = [r.text.encode().split() for r in steps[4].collect()]
    assert sum(map(len, words)) == taken and min(map(len, words)) > 0
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_every_row_of_the_mix_has_its_place(steps):
    assert ids(steps[5]) == ids(steps[4])
    places = {(r.shard, r.slot) for r in steps[5].collect()}
    assert len(places) == steps[4].count() and {s for s, _ in places} <= set(range(pipeline.SHARDS))


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    assert sorted(pipeline.run(spark, DIRECTORY).collect()) == sorted(steps[5].collect())


def test_odd_rows_pass_through(spark, messy, nothing):
    from pyspark.sql import functions as F

    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    one = pipeline.drop_near_copies(spark, docs, DIRECTORY)
    assert one.groupBy("doc_id", "text").count().where(F.col("count") > 1).count() == 0
    assert one.count() == len(set(classes([r.text for r in docs.collect()])))
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, DIRECTORY).count() == 0
        assert stage(spark, docs, DIRECTORY).count() > 0
