"""Line-addressed documents: numbering, ranges, gaps, overlaps, tilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators.ordering import numbered


def document_lines(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``(source_id, line_no, line)``, counted from 1."""
    return docs.select(F.col(key).alias("source_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("source_id", (F.col("pos") + 1).alias("line_no"), "line")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, both included; a start below 1 is 1), stripped."""
    first = F.greatest(start, F.lit(1))
    return T.strip(F.array_join(F.slice(T.lines(text), first, F.greatest(end - first + 1, F.lit(0))), "\n"))


def delete_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines that no range of their document covers; ranges are read out to line numbers, so the join is on equal keys."""
    gone = ranges.where("start_line <= end_line").select("source_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    return lines.join(gone, ["source_id", "line_no"], "left_anti")


def joined(lines: DataFrame) -> DataFrame:
    """``(source_id, text)``: a document's lines in order, stripped."""
    rows = lines.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return rows.select("source_id", T.strip(F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


def range_problems(ranges: DataFrame, line_counts: DataFrame) -> DataFrame:
    """``problem`` of each range: out_of_bounds, inverted, or overlap with a range before it; null if there is none."""
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.join(line_counts, "source_id")
    out = (F.col("start_line") < 1) | (F.col("end_line") > F.col("line_count"))
    return rows.withColumn("problem", F.when(out, "out_of_bounds").when(F.col("start_line") > F.col("end_line"), "inverted").when(F.col("start_line") <= before, "overlap"))


def gaps(spans: DataFrame, line_counts: DataFrame) -> DataFrame:
    """``(source_id, start_line, end_line)`` of lines no span covers: against the furthest end so far, and up to the last line."""
    last = line_counts.select("source_id", (F.col("line_count") + 1).alias("start_line"), (F.col("line_count") + 1).alias("end_line"))
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select("source_id", "start_line", "end_line").unionByName(last).withColumn("reach", F.coalesce(F.max("end_line").over(w), F.lit(0)))
    return rows.where("start_line > reach + 1").select("source_id", (F.col("reach") + 1).alias("start_line"), (F.col("start_line") - 1).alias("end_line"))


def overlaps(spans: DataFrame) -> DataFrame:
    """Where a span begins before the one just before it ends: ``(source_id, start_line, end_line)`` of what both cover."""
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line")
    rows = spans.withColumn("prev_end", F.lag("end_line").over(w))
    return rows.where("start_line <= prev_end").select("source_id", "start_line", F.least("end_line", "prev_end").alias("end_line"))


def tiling(spans: DataFrame, line_counts: DataFrame) -> DataFrame:
    """``(source_id, problem)``: the first thing that keeps the sorted spans from covering lines 1 to the last exactly once, or 'ok'."""
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line")
    rows = spans.join(line_counts, "source_id").withColumn("ord", F.row_number().over(w)).withColumn("expected", F.coalesce(F.lag("end_line").over(w), F.lit(0)) + 1)
    problem = (
        F.when((F.col("start_line") < 1) | (F.col("end_line") > F.col("line_count")), "out_of_bounds")
        .when(F.col("start_line") > F.col("end_line"), "inverted")
        .when(F.col("start_line") < F.col("expected"), "overlap")
        .when(F.col("start_line") > F.col("expected"), "gap")
    )
    found = rows.withColumn("problem", problem).groupBy("source_id").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("ord"))).alias("problem"), F.max("end_line").alias("last"), F.first("line_count").alias("line_count"))
    rest = line_counts.join(found.select("source_id"), "source_id", "left_anti").select("source_id", F.when(F.col("line_count") > 0, "gap").otherwise("ok").alias("problem"))
    return found.select("source_id", F.coalesce("problem", F.when(F.col("last") < F.col("line_count"), "gap").otherwise("ok")).alias("problem")).unionByName(rest)


def uncovered(ranges: DataFrame, locked: DataFrame) -> DataFrame:
    """``ranges`` less the ``locked`` lines, as maximal runs of lines."""
    rows = ranges.select("source_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    held = locked.select("source_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    rest = rows.join(held, ["source_id", "line_no"], "left_anti")
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("source_id").orderBy("line_no"))
    return rest.withColumn("run", run).groupBy("source_id", "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("run")


def nearest_units(units: DataFrame, problems: DataFrame) -> DataFrame:
    """For each problem range the unit that ends last before it and the one that starts first behind it."""
    both = problems.select("source_id", F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end")).join(units.select("source_id", "start_line", "end_line"), "source_id", "left")
    return both.groupBy("source_id", "p_start", "p_end").agg(
        F.max(F.when(F.col("end_line") < F.col("p_start"), F.col("end_line"))).alias("previous_end"), F.min(F.when(F.col("start_line") > F.col("p_end"), F.col("start_line"))).alias("next_start")
    )


def nearest_concept(units: DataFrame) -> DataFrame:
    """The start of the nearest concept unit before and behind each unit of a document."""
    w = Window.partitionBy("source_id").orderBy("start_line")
    own = F.when(F.col("unit_kind") == "concept", F.col("start_line"))
    return units.withColumn("concept_before", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("concept_after", F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def renumbered(units: DataFrame) -> DataFrame:
    """``source_order_index`` from 0 over all units by collection, file and start."""
    return numbered(units, "collection", "source_file", "start_line", "unit_id").withColumn("source_order_index", (F.col("rank") - 1).cast("long")).drop("rank")


def repair_window(units: DataFrame, problems: DataFrame) -> DataFrame:
    """``problems(source_id, start_line, end_line, title)`` -> the unit of each problem and its neighbours by place, as ``offset`` -1, 0 and 1."""
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line", "title")
    place = ["start_line", "end_line", "title"]
    rows = units.select("source_id", *place).withColumn("x", F.array(*[F.struct(F.lit(k).alias("offset"), *[(F.lag if k < 0 else F.lead)(c, abs(k)).over(w).alias(c) if k else F.col(c) for c in place]) for k in (-1, 0, 1)]))
    found = rows.join(problems.select("source_id", *place), ["source_id", *place]).select("source_id", F.col("start_line").alias("at"), F.explode("x").alias("x"))
    return found.where("x.start_line is not null").select("source_id", "at", "x.*")
