"""The decontamination stage of the pipeline with benchmark items of fewer words than a window."""

import corpus_pipeline as pipeline


def test_short_items_reject_nothing(spark, tmp_path):
    ten = "one two three four five six seven eight nine ten"
    texts = ["the cat sat", f"before {ten} after", "two three four five six seven eight nine ten", "one two three"]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = [(1, "cat"), (2, "one two"), (3, "two three four five six seven eight nine ten"), (4, ten)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [0, 2, 3]
