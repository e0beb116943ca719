"""The corpus pipeline: from raw documents to even shards of a mix, in five stages.

Each stage takes what its predecessor kept, judges it afresh, and returns documents with all their columns; the last
returns where each document goes. Rows are identified by their id and text, so tables whose ids repeat lose nothing.
Empty tables pass through all stages; NULL texts are empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.decontaminate import decontaminate
from tradewind.llm.mixing import mixed_documents
from tradewind.llm.quality import Settings, scorer, train
from tradewind.llm.sharding import shard_evenly
from tradewind.llm.similar import one_of_each, without
from tradewind.llm.store import stored

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, with a score of 0.5 or more."""
    settings = Settings()
    weights = train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", settings)
    return docs.where(scorer(spark, weights, settings)(F.col("text").cast("string")) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that a similarity of 0.8 of their five-word shingles links, the one with the smallest
    id; of rows that repeat its id, the smallest text by hash, once.

    Candidates come from SimHash: such pairs lie 8 to 10 of 64 bits apart, too far for one fingerprint, so that bands of a
    wide one bring them together. The bits that differ and then the exact sets decide.
    """
    return one_of_each(docs, "doc_id", "text", shingle=5, tenths=8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item; items of fewer words reject nothing."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, carry_key=True)
    ten = F.exists(F.arrays_zip("starts", "ends"), lambda span: span["ends"] - span["starts"] == 10)
    return without(docs, found.where(ten).select("doc_id", "row_key"), "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document once for each round that takes words of it, with these words."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix goes: doc_id, size, text_crc32, shard, slot."""
    return shard_evenly(docs, SHARDS)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

ORACLE_SQL = None  # a trained model and pseudorandom draws: tests compare with brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
