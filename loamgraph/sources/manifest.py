"""Material scans, manifests, generations and ledgers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.ids import fingerprint

#: File types that are taken in.
EXTENSIONS = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".pdf", ".docx", ".doc", ".ppt", ".pptx", ".txt", ".md"]


def is_supported(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).isin(EXTENSIONS) & ~name.startswith(".")


def collection_of(relative: Column) -> Column:
    parts = F.split(relative, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("default")


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("doc", "docx"), "docx").when(ext.isin("ppt", "pptx"), "presentation").when(ext.isin("txt", "md"), "text").when(F.concat(F.lit("."), ext).isin(EXTENSIONS), "image").otherwise("unknown")


def scan_materials(spark: SparkSession, root: str) -> DataFrame:
    """``(path, collection, source_file, fingerprint)`` of the supported files below ``root``; the fingerprint is of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), rf"^.*?{root.rstrip('/').split('/')[-1]}/", "")
    rows = files.select(path.alias("path"), "content").where(is_supported(F.col("path")))
    return rows.select("path", collection_of(F.col("path")).alias("collection"), F.element_at(F.split("path", "/"), -1).alias("source_file"), fingerprint(F.col("content")).alias("fingerprint"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of the text files below ``root``, each one row; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(kind_of(F.col("path")) == "text").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, fingerprint)`` of two scans -> ``(path, status)``: new, changed, unchanged or inactive."""
    both = now.select("path", F.col("fingerprint").alias("a")).join(before.select("path", F.col("fingerprint").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "inactive").when(F.col("b").isNull(), "new").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def generation_id(manifest: DataFrame) -> DataFrame:
    """One row, ``generation``: the SHA-256 of all paths and fingerprints, sorted by path and each followed by a zero character.

    The hash is that of one text, so the paths and fingerprints of a manifest (one short row for each file) meet in one row.
    """
    rows = manifest.select(F.struct("path", "fingerprint").alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(r["path"], F.lit("\0"), r["fingerprint"], F.lit("\0"))), "")
    return rows.agg(F.concat(F.lit("gen:"), F.substring(F.sha2(text, 256), 1, 24)).alias("generation"))


def reusable(cache: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached rows whose source, fingerprint and producer are still the wanted ones, and the wanted rows that need work."""
    keys = ["source_id", "fingerprint", "producer_signature"]
    return cache.join(wanted.select(*keys), keys, "left_semi"), wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of each key in ``rows`` replaced by them."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def ledger_upsert(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """``ledger(record, node_ids, ...)`` without the records that speak of a node of the new ones, and the new ones."""
    touched = records.select(F.explode("node_ids").alias("node")).distinct()
    gone = ledger.select("record", F.explode("node_ids").alias("node")).join(touched, "node", "left_semi").select("record").distinct()
    return ledger.join(gone, "record", "left_anti").unionByName(records)


def valid_records(ledger: DataFrame, files: DataFrame, generation: str) -> DataFrame:
    """Records of the generation (if they name one) whose file exists and has the recorded hash (if there is one)."""
    same = (F.lit(generation) == "") | (F.coalesce("generation_id", F.lit("")) == "") | (F.col("generation_id") == generation)
    there = files.select(F.col("path").alias("output_path"), "sha256")
    rows = ledger.where(same & (F.coalesce("output_path", F.lit("")) != "")).join(there, "output_path")
    return rows.where((F.coalesce("output_sha256", F.lit("")) == "") | (F.col("output_sha256") == F.col("sha256"))).drop("sha256")


def covered_nodes(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.explode(F.array_union(F.array("node_id"), F.coalesce("node_ids", F.array().cast("array<string>")))).alias("node")).where("node <> ''").distinct()


def complete_documents(chunks: DataFrame, *, model: str | None = None) -> DataFrame:
    """``chunks(doc_id, document_sha256, embedding_model, document_chunk_count)`` -> ``(doc_id, complete)``.

    Complete: all rows expect the same number of chunks and so many are there, with one hash and one model (the current one).
    """
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))  # noqa: E731  distinct counts would write each row once for each column
    ok = one("document_sha256") & one("embedding_model") & one("document_chunk_count") & (F.max("document_chunk_count") == F.count("*"))
    if model:
        ok = ok & (F.max("embedding_model") == model)
    return chunks.groupBy("doc_id").agg(ok.alias("complete"))


def page_ranges(files: DataFrame, *, most: int = 99) -> DataFrame:
    """``files(path, pages)`` -> ``(path, first, last, name)``: page ranges of ``most`` pages, named by them."""
    rows = files.select("path", "pages", F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)), F.lit(most))).alias("first"))
    rows = rows.withColumn("last", F.least(F.col("first") + most - 1, F.col("pages")))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    return rows.select("path", "first", "last", F.format_string("%s__pages-%04d-%04d", stem, F.col("first"), F.col("last")).alias("name"))


def unique_names(files: DataFrame) -> DataFrame:
    """``files(dir, name, ord)`` with later equal names as ``name 2.ext``, ``name 3.ext``."""
    n = F.row_number().over(Window.partitionBy("dir", "name").orderBy("ord"))
    ext = F.regexp_extract("name", r"\.[^.]+$", 0)
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    return files.withColumn("n", n).withColumn("stored_name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" "), F.col("n").cast("string"), ext))).drop("n")


def ocr_pages(lines: DataFrame) -> DataFrame:
    """``lines(file, ord, value)`` of JSON results -> ``(file, pages, text)``: the pages' texts in order, an empty line between."""
    schema = "result struct<layoutParsingResults: array<struct<markdown: struct<text: string>>>>"
    rows = lines.select("file", "ord", F.posexplode(F.from_json("value", schema)["result"]["layoutParsingResults"]).alias("page", "x"))
    rows = rows.groupBy("file").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("ord", "page", F.col("x.markdown.text").alias("text")))).alias("t"))
    return rows.select("file", "pages", F.array_join(F.transform("t", lambda r: r["text"]), "\n\n").alias("text"))
