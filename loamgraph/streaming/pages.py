"""Progress by pages: a stream of planned page ranges meets a stream of what their jobs report.

What either stream has brought is kept as tables in the shared folder, not in the memory of executors: a batch joins what is new with what is held, as a shuffle that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.sources.stages import finished_parts, new_path

REPORTS = "file long, chunk int, pages long, file_pages long, ts timestamp, event_id string, done long, text string"
#: The rows of both streams; ``planned`` tells them apart, ``at`` is when a range was planned or a report was made, ``until`` how long reports of a range count.
HELD = "planned boolean, file long, chunk int, pages long, file_pages long, at timestamp, until timestamp, late interval day to second, event_id string, done long, text string"


def reported(plan: DataFrame, reports: DataFrame, *, delay: str = "1 hour", horizon: str = "7 days") -> DataFrame:
    """Streams ``plan(file, chunk, pages, file_pages, planned_at)`` and ``reports(file, chunk, ts, event_id, done, text)`` -> both as one stream of HELD rows, for ``kept_reports`` to join.

    A report counts from the planning on and for ``horizon`` after it; either stream may be late by ``delay``. Beyond that its rows aren't read again, so what a
    batch joins doesn't grow with the streams. Reports of ranges that aren't planned, and those with a null file, chunk or ts, give no rows. ``done`` is brought between 0 and the range's pages; null is 0.
    """
    late = F.expr(f"cast(interval {delay} as interval day to second)")
    end = F.col("planned_at") + F.expr(f"interval {horizon}")
    ranges = plan.select(F.lit(True).alias("planned"), "file", "chunk", "pages", "file_pages", F.col("planned_at").alias("at"), end.alias("until"), late.alias("late"))
    said = reports.select(F.lit(False).alias("planned"), "file", "chunk", F.col("ts").alias("at"), late.alias("late"), "event_id", "done", "text")
    return ranges.unionByName(said, allowMissingColumns=True).where("file is not null and chunk is not null and at is not null")


def _matches(ranges: DataFrame, said: DataFrame) -> DataFrame:
    p, r = ranges.alias("p"), said.alias("r")
    done = F.least(F.greatest(F.coalesce("r.done", F.lit(0)), F.lit(0)), F.col("p.pages"))
    rows = p.join(r, F.expr("p.file = r.file AND p.chunk = r.chunk AND r.at >= p.at AND r.at <= p.until"))
    return rows.select("p.file", "p.chunk", "p.pages", "p.file_pages", F.col("r.at").alias("ts"), "r.event_id", done.cast("long").alias("done"), "r.text")


def _open(held: DataFrame) -> Column | None:
    """Which held rows later ones may still meet: those that the slower of both streams, late as it may be, hasn't passed; null while either stream has brought nothing."""
    last = {r["planned"]: r for r in held.groupBy("planned").agg(F.max(F.col("at") - F.col("late")).alias("mark")).collect()}  # two rows
    return F.coalesce("until", "at") >= F.lit(min(r["mark"] for r in last.values())) if len(last) == 2 else None


def kept_reports(both: DataFrame) -> DataFrame:
    """Runs the stream of ``reported`` over what is there and returns ``(file, chunk, pages, file_pages, ts, event_id, done, text)``, a row for each report of a planned range.

    A batch first writes its own rows, then what they make with each other and with those of earlier batches; one that is written again replaces its own files.
    """
    spark = both.sparkSession
    out, held, marks = new_path(spark, "pages"), new_path(spark, "pages-held"), new_path(spark, "pages-marks")
    part = lambda rows, planned: rows.where(F.col("planned") == planned)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{held}/batch={number}")
        new = spark.read.schema(HELD).parquet(f"{held}/batch={number}")
        rows = _matches(part(new, True), part(new, False))
        if earlier := [f"{held}/batch={n}" for n in finished_parts(spark, held, "batch") if n < number]:
            old = spark.read.schema(HELD).parquet(*earlier)
            if (still := _open(old)) is not None:
                old = old.where(still)
            rows = rows.unionByName(_matches(part(old, True), part(new, False))).unionByName(_matches(part(new, True), part(old, False)))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    both.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(REPORTS + ", batch long").parquet(out).drop("batch")


def file_progress(matched: DataFrame) -> DataFrame:
    """``(file, ts, event_id, done)``: the pages of a file that are done after each report, in the order of ts and event_id, whatever order ranges report in.

    A range never goes back: a report adds what it is ahead of all before it. The sum stays within the file's pages.
    """
    matched = matched.repartition("file")  # serves both windows
    so_far = Window.partitionBy("file", "chunk").orderBy("ts", "event_id", "done").rowsBetween(Window.unboundedPreceding, -1)
    rows = matched.withColumn("more", F.greatest(F.col("done") - F.coalesce(F.max("done").over(so_far), F.lit(0)), F.lit(0)))
    up_to = Window.partitionBy("file").orderBy("ts", "event_id")
    return rows.select("file", "ts", "event_id", F.least(F.sum("more").over(up_to), F.col("file_pages")).alias("done"))


def whole_files(plan: DataFrame, matched: DataFrame) -> DataFrame:
    """``plan(file, chunk, ...)``, reports -> ``(file, chunks, missing, text)``: how many ranges a file has, which of them gave no text or a blank one, and the text if none is missing.

    A range's text is that of its last report with one; the parts are joined in order with an empty line between.
    """
    said = matched.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "").groupBy("file", "chunk").agg(F.max_by("text", F.struct("ts", "event_id", "text")).alias("text"))
    rows = plan.select("file", "chunk").distinct().join(said, ["file", "chunk"], "left").groupBy("file").agg(
        F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("chunk")))).alias("missing"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("x")
    )
    return rows.select("file", "chunks", "missing", F.when(F.size("missing") == 0, F.array_join(F.transform("x", lambda r: r["text"]), "\n\n")).alias("text"))
