"""Numbering of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.sources.stages import stored

#: A row's number holds its partition above so many bits, and its place there below.
PLACE_BITS = 33


def numbered(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``rows`` with their places from 1 in the order of ``order``.

    Rows are sorted in ranges; each range counts its rows, and the counts (one row for each range) are summed. Ties take neighbouring
    places in any order. No rows give no rows.
    """
    held = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__range", F.shiftright("__at", PLACE_BITS))
    counts = held.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.col("__at") - F.shiftleft(F.col("__range"), PLACE_BITS) + F.col("__offset") + 1
    return held.join(F.broadcast(offsets), "__range").withColumn(name, place.cast("int")).drop("__at", "__range", "__offset")


def numbered_within(rows: DataFrame, group: str, *order: str, name: str = "rank") -> DataFrame:
    """``rows`` with their places from 1 among those of their ``group``; a group may hold any share of the rows."""
    placed = stored(numbered(rows, group, *order, name="__all"), "numbered")
    first = placed.groupBy(group).agg(F.min("__all").alias("__first"))
    return placed.join(first, group).withColumn(name, F.col("__all") - F.col("__first") + 1).drop("__all", "__first")
