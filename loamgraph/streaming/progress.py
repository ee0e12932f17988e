"""Progress of staged runs as a stream: the state of each stage is kept as tables in the shared folder, and a batch takes it on by joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.stages import finished_parts, new_path

STATE = "project long, stage string, run long, done long, total long, status string"
#: Batches after which the states of all stages are written, so that a batch reads so many tables of changes at most.
WHOLE = 16


def advanced(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``events(project, stage, run, ts, event_id, step, total, failed)``, STATE rows -> STATE rows of the stages that have events, each taken on from the one held, if there is one.

    Later runs take over and keep the counts, events of earlier runs are late and go; one without a run belongs to the run that is on. ``done`` adds up and never passes ``total``; the stage is
    complete when it gets there, running from its first step on, and a failure holds until a later run.

    Runs don't go back, so a failure holds if the last one before belongs to the same run. Taken step by step, ``done`` is what is held plus all steps, or if that is less, what ``total`` was at
    some event plus the steps after it.
    """
    key, nothing = ["project", "stage"], F.lit(0).cast("long")
    plain = lambda c: F.coalesce(F.col(c).cast("long"), nothing)
    rows = events.select(*key, F.col("run").cast("long").alias("run"), "ts", "event_id", plain("step").alias("step"), plain("total").alias("more"), F.coalesce("failed", F.lit(False)).alias("failed"))
    first = {"run0": F.lit(-1).cast("long"), "done0": nothing, "total0": nothing, "status0": F.lit("pending")}
    if held is None:
        rows = rows.withColumns(first)
    else:
        own = held.select(F.col("project").alias("project0"), F.col("stage").alias("stage0"), *[F.col(c[:-1]).alias(c) for c in first])
        rows = rows.join(own, F.expr("project <=> project0 AND stage <=> stage0"), "left").drop("project0", "stage0").withColumns({c: F.coalesce(c, v) for c, v in first.items()})
    order = [F.asc_nulls_last(c) for c in ("ts", "event_id", "run", "failed", "step", "more")]
    up_to = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.greatest("run0", F.max("run").over(up_to))
    rows = rows.withColumn("latest", latest).withColumn("on", F.coalesce(F.col("run") == F.col("latest"), F.lit(True)))
    failure = F.greatest(F.when(F.col("status0") == "failed", F.col("run0")), F.max(F.when(F.col("on") & F.col("failed"), F.col("latest"))).over(before))
    rows = rows.withColumn("on", F.col("on") & ~F.coalesce(failure == F.col("latest"), F.lit(False)))
    step, more = F.when(F.col("on"), F.col("step")).otherwise(nothing), F.when(F.col("on"), F.col("more")).otherwise(nothing)
    rows = rows.withColumn("steps", F.sum(step).over(up_to)).withColumn("sum", F.col("total0") + F.sum(more).over(up_to)).withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    on = lambda c: F.when(F.col("on"), c)
    rows = rows.groupBy(*key).agg(
        F.max("latest").alias("run"), F.max("done0").alias("done0"), F.max("status0").alias("status0"), F.min(on(F.col("sum") - F.col("steps"))).alias("least"),
        F.max(F.struct("at", "steps", "sum")).alias("end"), F.max(on(F.struct("at", "failed"))).alias("last"),
    )
    done, total = F.col("end.steps") + F.least("done0", "least"), F.col("end.sum")
    status = F.when(F.col("last").isNull(), F.col("status0")).when(F.col("last.failed"), "failed").when((total != 0) & (done >= total), "complete").when(done != 0, "running").otherwise("pending")
    return rows.select(*key, "run", done.alias("done"), total.alias("total"), status.alias("status"))


def _last(rows: DataFrame) -> DataFrame:
    """Of STATE rows with their ``batch``, the last one of each stage."""
    return rows.groupBy("project", "stage").agg(F.max(F.struct("batch", "run", "done", "total", "status")).alias("x")).select("project", "stage", "x.run", "x.done", "x.total", "x.status")


def latest_states(events: DataFrame) -> DataFrame:
    """Runs ``advanced`` over the batches of a stream, and returns the state of each stage.

    A batch writes the stages that it changes as Parquet to the shared folder under its number, so that one written again replaces itself; each of WHOLE batches writes all stages as well.
    """
    spark = events.sparkSession
    changed, whole, marks = new_path(spark, "progress"), new_path(spark, "progress-whole"), new_path(spark, "progress-marks")

    def states(until: int) -> DataFrame | None:
        """The states after the batches before ``until``: the last table of all stages, and what later batches changed; none if there are none."""
        base = max((n for n in finished_parts(spark, whole, "batch") if n < until), default=-1)
        paths = [f"{whole}/batch={base}"] if base >= 0 else []
        paths += [f"{changed}/batch={n}" for n in finished_parts(spark, changed, "batch") if base < n < until]
        batch = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/[^/]*\z", 1).cast("long")
        return _last(spark.read.schema(STATE).parquet(*paths).withColumn("batch", batch)) if paths else None

    def keep(batch: DataFrame, number: int) -> None:
        advanced(batch, states(number)).write.mode("overwrite").parquet(f"{changed}/batch={number}")
        if number % WHOLE == WHOLE - 1:
            states(number + 1).write.mode("overwrite").parquet(f"{whole}/batch={number}")

    events.writeStream.foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    last = states(2**62)
    return spark.createDataFrame([], STATE) if last is None else last


def monotonic(events: DataFrame) -> DataFrame:
    """``events(file, part, done, part_total, file_total)`` -> ``(file, done)``: each part's furthest step, added up, within the totals."""
    parts = events.groupBy("file", "part").agg(F.max(F.least("done", F.coalesce("part_total", "done"))).alias("done"), F.max("file_total").alias("file_total"))
    return parts.groupBy("file").agg(F.least(F.sum("done"), F.max("file_total")).alias("done"))


def changes(events: DataFrame, *, key: str, order: list[str], value: str) -> DataFrame:
    """The events whose value differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag(value).over(w)).where(~F.col("before").eqNullSafe(F.col(value))).drop("before")


def last_errors(errors: DataFrame, *, key: list[str], by: str, order: list[str], limit: int = 20) -> DataFrame:
    """Each different error once, at its latest place; of a ``by`` the last ``limit``."""
    newest = Window.partitionBy(by, *key).orderBy(*[F.desc(c) for c in order])
    rows = errors.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")
    last = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= limit).drop("r")


def reading_states(events: DataFrame) -> DataFrame:
    """``events(node, ts, event_id, action)`` (open, read, unread, revise) -> ``(node, reading_status)`` after the last of them."""
    decisive = events.where(F.col("action") != "open").groupBy("node").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at"))
    opened = events.where(F.col("action") == "open").groupBy("node").agg(F.max("ts").alias("opened"))
    rows = decisive.join(opened, "node", "full_outer")
    status = F.when(F.col("last") == "read", "read").when(F.col("opened").isNotNull() & (F.col("at").isNull() | (F.col("opened") > F.col("at"))), "reading").otherwise("unread")
    return rows.select("node", status.alias("reading_status"))
