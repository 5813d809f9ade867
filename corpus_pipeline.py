"""A corpus pipeline: five stages over documents, each written as Parquet and read by the next.

1. language_id drops documents without letters or without a language that most of their words have;
2. near_duplicates leaves the document with the least doc_id of each class of near copies;
3. decontaminate drops documents that hold a 10-word window of a benchmark item;
4. mix_sources repeats and drops documents until each source has its share;
5. shard deals what is left into 16 shards of equal size and returns doc_id, size, text_crc32,
   law, shard, slot and grown_shard.

All stages but the last return the columns of their input.  SQL can't express the first two, so
there is no ORACLE_SQL; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from textloom.llm.common import cut

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 16)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("shard", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
