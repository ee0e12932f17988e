"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm import decontamination, mixing, sharding, simhash_dedup, toxicity
from loamgraph.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models score 0.7 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document of the smallest id stays."""
    return simhash_dedup.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are read up to twice; every document is read once at least."""
    return mixing.mix_documents(docs, repetition=2.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and each row's size, checksum, place in the hash tree and slot in its shard."""
    return sharding.assign(docs, sharding.tree(24), carry=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the fitted models nor the connected components; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
