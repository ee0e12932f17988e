"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import (
    chat_format,
    decontamination,
    licenses,
    line_dedup,
    mixing,
    periodic_runs,
    pii,
    quality_rules,
    sharding,
    simhash_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from loamgraph.llm.common import table


def op1_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents with their verdicts; nulls, ties and empty tables as in ``line_dedup.document_lines``."""
    return line_dedup.document_lines(table(spark, sf_dir, "documents"))


def op2_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the forest's verdict for all documents; nulls, several rows of one id and missing labels as in ``quality_rules.judge``."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of all documents; null texts are empty, repeated rows fare alike, as in ``pii.find``."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op4_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; null and empty texts have none, as in ``licenses.scan``."""
    docs = table(spark, sf_dir, "documents")
    return licenses.document_licenses(licenses.scan(docs, licenses.train(docs)))


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that they hold; null texts hold none, as in ``decontamination.contaminations``."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents; null texts and ids as in ``simhash_dedup.simhash_components``."""
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's stream of all documents with no source read more than twice; null ids and sources as in ``mixing.permuted``."""
    rows = mixing.permuted(mixing.mixture(table(spark, sf_dir, "documents"), repetition=2.0))
    return rows.withColumn("weight", F.round("weight", 9)).withColumn("order_key", F.round("order_key", 9))


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents, with one more shard, too; null ids and texts as in ``sharding.shard_documents``."""
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op9_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back; null texts are empty, as in ``chat_format.format_paths``."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], told.schema)
    tree = chat_format.linear_tree(told.unionByName(extra))
    return chat_format.digests(chat_format.format_paths(tree, top=1))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null texts score as empty ones, as in ``toxicity.score_documents``."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four codebooks of 256 entries, fitted in four rounds; what nulls, ties and empty tables give is said in ``compress``."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more in all documents, tails of a tenth of them repeated first; nulls and ties as in ``run_columns``."""
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the byte-level vocabulary, and whether they are over 1024; nulls and ties as in ``prefix_steps``."""
    return token_counts.digest(token_counts.prefix_table(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_deletion_line_dedup": op1_deletion_line_dedup,
    "op2_isolation_forest_quality": op2_isolation_forest_quality,
    "op3_disclosure_pii": op3_disclosure_pii,
    "op4_license_classifier": op4_license_classifier,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_hash_tree_sharding": op8_hash_tree_sharding,
    "op9_reply_tree_chat": op9_reply_tree_chat,
    "op10_kneser_ney_toxicity": op10_kneser_ney_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {
    "op1_deletion_line_dedup": line_dedup.ORACLE,
    "op7_temperature_mixing": mixing.ORACLE,
    "op8_hash_tree_sharding": sharding.ORACLE,
    "op9_reply_tree_chat": chat_format.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}
