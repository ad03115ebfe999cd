"""A corpus pipeline over five of the training-data operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from descant.llm import decontamination, mixing, neardup, quality, sharding
from descant.llm.common import cut, release, scope, tables

#: No stage can be told in SQL as a whole (signatures, divergence, block-max WAND); tests hold each
#: stage against a brute-force version.
ORACLE_SQL = None
SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return neardup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep(docs, tables(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the mix as often as the schedule takes its words: once for each round
    that takes at least half of what it holds. Documents that the schedule leaves out go."""
    return mixing.materialise(docs).select(*docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
    ("sharding", shard_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's tables, and its input, are deleted once its result is written: one table is left."""
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope() as keep:
            result = keep(cut(stage(spark, docs, sf_dir)))
        release(docs)
        docs = result
    return docs
