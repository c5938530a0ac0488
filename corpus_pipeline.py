"""From raw documents to shards for training: five stages, each written and read back.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  An empty table passes through every stage.  What a stage does with nulls,
ties, repeated rows and very long texts is said in its operator's module; in short, a null or
empty text is no known language and goes in the first stage, a null id is a document like any
other, and repeated rows are near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexorder.llm import decontaminate, language_id, mixing, near_copies, ring
from lexorder.llm.common import free_name, utf8
from lexorder.staging import Stages

MAJORITY = 0.5      # a long text whose language scores below this is in none that is known
LONG = 100          # characters from which a low score is no lack of evidence
SHARDS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: not ``und``, nor long without a majority of the score."""
    model = language_id.fit(language_id.train_fold(docs))
    found = free_name(docs, "found")
    unknown = (F.length("text") >= LONG) & (F.col(found)["score"] < MAJORITY)
    return (docs.withColumn(found, language_id.predict(docs, model))
            .filter((F.col(found)["lang"] != "und") & ~unknown).drop(found))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 or more.

    Fingerprints linked by op2's vantage-point trees propose pairs, and so do min-hashes; the exact
    similarity decides.
    """
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(
        f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix: a row for each time a document is taken whole, and one for a part."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they belong to and their place in it."""
    return ring.shard_rows(docs, "doc_id", F.crc32(utf8("text")), SHARDS)


STAGES = [
    ("language ID", known_language),
    ("near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

# Hash codes of shingles, learned n-grams and edit distances have no SQL form here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result is read from the last stage's table."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stages.save(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            stages.remove(f"stage-{number - 1}")
    return docs
