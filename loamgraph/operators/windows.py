"""Windows of lines whose replies were cut short: halved until they fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.sources.stages import stored


def halved_windows(windows: DataFrame, truncated: Callable[[DataFrame], DataFrame], *, smallest: int = 100) -> DataFrame:
    """``windows(source_id, start_line, end_line)`` -> the windows they end up as, with ``outcome``: 'cleaned', or 'unchanged' where a reply is still cut short.

    ``truncated`` is asked once a round about all windows that are open, and gives those whose reply was cut short (by the three columns). Of these, such of over
    ``smallest`` lines go on as two halves, the first the shorter one; others stay as they are. The rounds are the logarithm of the longest window; only
    open windows are carried from one to the next. Windows with a null or without a line go; equal windows are one.
    """
    keys = ["source_id", "start_line", "end_line"]
    size = F.col("end_line") - F.col("start_line") + 1
    open_ = stored(windows.select(*[F.col(c).cast("long") if c != "source_id" else F.col(c) for c in keys]).where("start_line <= end_line and source_id is not null").distinct(), "windows")
    settled = []
    while not open_.isEmpty():
        cut = truncated(open_).select(*keys).distinct().withColumn("cut", F.lit(True))
        asked = stored(open_.join(cut, keys, "left").withColumn("cut", F.coalesce("cut", F.lit(False))), "asked-windows")
        again = F.col("cut") & (size > smallest)
        settled.append(asked.where(~again).select(*keys, F.when(F.col("cut"), "unchanged").otherwise("cleaned").alias("outcome")))
        middle = F.expr("start_line + (end_line - start_line + 1) div 2")
        halves = F.array(F.struct(F.col("start_line").alias("s"), (middle - 1).alias("e")), F.struct(middle.alias("s"), F.col("end_line").alias("e")))
        open_ = asked.where(again).select("source_id", F.explode(halves).alias("h")).select("source_id", F.col("h.s").alias("start_line"), F.col("h.e").alias("end_line"))
    out = open_.withColumn("outcome", F.lit("cleaned"))  # without rows
    for part in settled:
        out = out.unionByName(part)
    return out


def window_costs(windows: DataFrame, running: DataFrame) -> DataFrame:
    """``running(source_id, line_no, total)``, where ``total`` adds up all lines so far -> windows with their ``cost``; joins on equal keys only."""
    end = running.select("source_id", F.col("line_no").cast("long").alias("end_line"), F.col("total").alias("__to"))
    start = running.select("source_id", (F.col("line_no") + 1).cast("long").alias("start_line"), F.col("total").alias("__from"))
    rows = windows.join(end, ["source_id", "end_line"]).join(start, ["source_id", "start_line"], "left")
    return rows.withColumn("cost", F.col("__to") - F.coalesce("__from", F.lit(0))).drop("__to", "__from")


def window_texts(settled: DataFrame, lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """``lines(source_id, line_no, line)``, ``deleted(source_id, line_no)`` -> ``(source_id, text)``: the windows' texts in order, without those that are empty.

    Lines are deleted in cleaned windows only. Each window is stripped by itself. Windows are read out to line numbers, so the joins are on equal keys.
    A source whose windows hold no line that is there has no row.
    """
    places = settled.select("source_id", "start_line", "outcome", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    gone = deleted.select("source_id", F.col("line_no").cast("long").alias("line_no"), F.lit(True).alias("gone")).distinct()
    rows = lines.select("source_id", F.col("line_no").cast("long").alias("line_no"), "line").join(places, ["source_id", "line_no"]).join(gone, ["source_id", "line_no"], "left")
    kept = F.when(F.col("gone").isNull() | (F.col("outcome") != "cleaned"), F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))
    parts = rows.groupBy("source_id", "start_line").agg(F.array_sort(F.collect_list(kept)).alias("x"))
    parts = parts.select("source_id", "start_line", T.strip(F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
    whole = parts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("start_line", "text")))).alias("x"))
    return whole.select("source_id", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))
