"""Publishing in steps that can be taken again: a file, its place in the index, and its record in the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgraph.sources.stages import finished_parts


def recovery(transactions: DataFrame, files: DataFrame) -> DataFrame:
    """``transactions(node, filename, output_sha256)``, ``files(filename, sha256)`` -> ``(node, action)`` for runs that stopped in between.

    'forget' one whose file isn't there (it is made anew), 'refuse' one whose file has another hash, and 'commit' others: their index
    entry and their record are written, again if they had been.
    """
    here = files.select("filename", "sha256", F.lit(True).alias("there"))
    rows = transactions.join(here, "filename", "left")
    changed = (F.coalesce("output_sha256", F.lit("")) != "") & (F.col("output_sha256") != F.col("sha256"))
    return rows.select("node", F.when(F.col("there").isNull() | (F.coalesce("filename", F.lit("")) == ""), "forget").when(changed, "refuse").otherwise("commit").alias("action"))


def add_records(records: DataFrame, ledger: str, batch: int) -> None:
    """Writes ``records(record, node_ids, ...)`` as a delta of the ledger; a batch written again replaces its own files and no others."""
    records.write.mode("overwrite").parquet(f"{ledger}/delta/batch={batch}")


def _latest(rows: DataFrame) -> DataFrame:
    """Records with their ``batch``, without those that speak of a node of a later batch."""
    last = rows.select("batch", F.explode("node_ids").alias("node")).groupBy("node").agg(F.max("batch").alias("last"))
    gone = rows.select("batch", "record", F.explode("node_ids").alias("node")).join(last, "node").where("batch < last").select("batch", "record").distinct()
    return rows.join(gone, ["batch", "record"], "left_anti")


def _with_batches(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    whole = finished_parts(spark, f"{ledger}/whole", "upto")
    upto = max(whole, default=-1)
    reader = spark.read.schema(f"{schema}, batch long")
    deltas = [f"{ledger}/delta/batch={n}" for n in finished_parts(spark, f"{ledger}/delta", "batch") if n > upto]
    rows = spark.createDataFrame([], f"{schema}, batch long")
    if whole:
        rows = rows.unionByName(reader.parquet(f"{ledger}/whole/upto={upto}"))
    if deltas:
        rows = rows.unionByName(reader.option("basePath", f"{ledger}/delta").parquet(*deltas))
    return rows


def read_ledger(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The ledger as its batches leave it: a record goes when a later batch has one that shares a node with it.

    Reads the last compacted table and the deltas after it, finished ones only. Records of one batch don't replace each other, and one without nodes stays. A ledger
    that isn't there is empty. ``record`` must not be null, and tells the records of a batch apart.
    """
    return _latest(_with_batches(spark, ledger, schema)).drop("batch")


def compact_ledger(spark: SparkSession, ledger: str, schema: str) -> int:
    """Writes the ledger up to its last finished delta as one table, and returns that delta's number (-1: there is nothing to do).

    Readers use the table once it is finished; nothing that they may be reading is changed. Records keep their batches, so a batch that is written
    again after that has to be compacted again.
    """
    upto = max(finished_parts(spark, f"{ledger}/delta", "batch"), default=-1)
    if upto > max(finished_parts(spark, f"{ledger}/whole", "upto"), default=-1):
        _latest(_with_batches(spark, ledger, schema).where(F.col("batch") <= upto)).write.mode("overwrite").parquet(f"{ledger}/whole/upto={upto}")
    return upto


def publish_stream(records: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Adds a stream of records ``(record, node_ids, output_path)`` to a ledger, each batch as a delta: its cost doesn't depend on the ledger's size.

    A batch written again replaces its own delta, so one that failed half-way leaves nothing twice.
    """

    def commit(batch: DataFrame, number: int) -> None:
        add_records(batch, ledger, number)

    return records.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
