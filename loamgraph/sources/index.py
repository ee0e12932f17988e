"""Upkeep of the chunk index: documents replaced whole, node ids filled in, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import vectors as V


def chunk_problems(chunks: DataFrame, *, dims: int) -> DataFrame:
    """``chunks(doc_id, vector, document_chunk_count)`` -> ``(doc_id, problem)``: why a document can't be indexed, null if it can.

    It has no chunk of its announced number, a vector is missing or has fewer than ``dims`` numbers, or one of them isn't finite.
    """
    rows = chunks.groupBy("doc_id").agg(
        F.bool_or(F.col("document_chunk_count").isNull()).alias("no_count"), F.max("document_chunk_count").alias("want"), F.count("*").alias("got"),
        F.bool_or(F.coalesce(F.size("vector"), F.lit(0)) < dims).alias("short"), F.bool_or(~F.coalesce(V.is_finite(F.col("vector")), F.lit(False))).alias("odd"),
    )
    return rows.select("doc_id", F.when(F.col("no_count") | (F.col("want") != F.col("got")), "count").when(F.col("short"), "dimensions").when(F.col("odd"), "not_finite").alias("problem"))


def index_documents(index: DataFrame, chunks: DataFrame, *, dims: int) -> DataFrame:
    """``index`` with the documents of ``chunks`` replaced whole; documents with a problem are left as they were. Vectors are cut to ``dims``."""
    good = chunk_problems(chunks, dims=dims).where("problem is null").select("doc_id")
    new = chunks.join(good, "doc_id", "left_semi").withColumn("vector", F.slice("vector", 1, dims))
    return index.join(good, "doc_id", "left_anti").unionByName(new.select(index.columns))


def delete_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def unit_documents(units: DataFrame) -> DataFrame:
    """``units(unit_id, collection, source_file, text)`` as documents: the unit's id names the document, collection and file its path."""
    return units.select(F.col("unit_id").alias("doc_id"), F.lit("source").alias("content_kind"), F.concat_ws("/", "collection", "source_file").alias("path"), F.col("source_file").alias("filename"), "text")


def finished_documents(files: DataFrame) -> DataFrame:
    """``files(node, path, text)`` as documents of the kind 'finished': the node is the collection, and what stands before the name's first dot the sequence number."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.concat_ws(":", F.lit("finished"), "node", "path").alias("doc_id"), F.lit("finished").alias("content_kind"), F.col("node").alias("collection"), "path", F.split(name, r"\.")[0].alias("file_seq"), "text")


def with_node_ids(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """``index`` with ``node_id`` of source chunks from ``nodes(unit, node_id)`` (the last one by id counts); blank ids change nothing."""
    new = nodes.where(F.coalesce("node_id", F.lit("")) != "").groupBy("unit").agg(F.max("node_id").alias("__new"))
    rows = index.join(new, "unit", "left")
    return rows.withColumn("node_id", F.when(F.col("content_kind") == "source", F.coalesce("__new", "node_id")).otherwise(F.col("node_id"))).select(index.columns)


def unit_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes(ord, node, members)`` -> ``(unit, node)``: the last node that has each unit."""
    return nodes.select("ord", "node", F.explode("members").alias("unit")).groupBy("unit").agg(F.max_by("node", F.struct("ord", "node")).alias("node"))


def unindexed(units: DataFrame, index: DataFrame) -> DataFrame:
    """Units without a chunk in the index."""
    return units.join(index.select("unit").distinct(), "unit", "left_anti")


def current(artifacts: DataFrame, committed: DataFrame) -> DataFrame:
    """``artifacts(generation_id, ...)`` of the one committed generation; an artifact of another one isn't seen."""
    return artifacts.join(committed.select("generation_id").distinct(), "generation_id", "left_semi")
