"""From raw documents to shuffled shards: quality rules, near copies, benchmark leaks, source weights, sharding.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of ``documents``; the last one
adds shard and slot. ``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aeroframe.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from aeroframe.llm.text import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word n-grams, similarity 0.8) the document with the smallest id."""
    return ngram_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mixing.repeat(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffled shards, with shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [("quality rules", rules), ("near copies", near_copies), ("benchmark leaks", leaks), ("source weights", mixed), ("sharding", shards)]

#: MinHash banding, slot checks and seeded permutations have no SQL form; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
