"""Scheduling and status views over a prerequisite graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as T

#: The states that histograms always show.
STATUSES = ["complete", "ready", "locked", "running", "failed"]
READING = ["unread", "reading", "read", "recommended"]


def missing_parents(nodes: DataFrame, edges: DataFrame, have: DataFrame) -> DataFrame:
    """``(node, missing)``: how many direct parents of each node aren't in ``have(node)``."""
    open_edges = edges.join(have.select(F.col("node").alias("src")), "src", "left_anti")
    counts = open_edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("missing"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("missing", F.lit(0)).alias("missing"))


def ready_nodes(nodes: DataFrame, edges: DataFrame, covered: DataFrame, busy: DataFrame | None = None, *, max_active: int | None = None) -> DataFrame:
    """Nodes not covered nor busy whose parents are all covered; with ``max_active`` the first so many less the busy ones."""
    rows = missing_parents(nodes, edges, covered).where("missing = 0").select("node").join(covered, "node", "left_anti")
    if busy is not None:
        rows = rows.join(busy, "node", "left_anti")
    if max_active is not None:
        rows = rows.orderBy("node").limit(max(0, max_active - (busy.count() if busy is not None else 0)))
    return rows


def node_status(nodes: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """``state(node, covered, failed, active)`` -> ``(node, status)``: complete, failed, running, ready or locked, whichever holds first."""
    covered = state.where("covered").select("node")
    rows = missing_parents(nodes, edges, covered).join(state, "node", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(yes("covered"), "complete").when(yes("failed"), "failed").when(yes("active"), "running").when(F.col("missing") == 0, "ready").otherwise("locked")
    return rows.select("node", status.alias("status"))


def histogram(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of the domain, zeros included."""
    values = rows.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def reading_view(status: DataFrame, edges: DataFrame, reading: DataFrame) -> DataFrame:
    """``status(node, status)``, ``reading(node, reading_status)`` -> ``(node, reading_status, reason, ready)``.

    A generated, unread node whose parents are all read is recommended; unknown reading states are unread.
    ``ready`` holds for all nodes or none: everything is generated.
    """
    known = reading.select("node", F.when(F.col("reading_status").isin("reading", "read"), F.col("reading_status")).otherwise("unread").alias("own"))
    read = known.where("own = 'read'").select("node")
    parents = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("parents"))
    rows = status.join(known, "node", "left").join(missing_parents(status, edges, read), "node").join(parents, "node", "left")
    own = F.coalesce("own", F.lit("unread"))
    hit = (F.col("status") == "complete") & (own == "unread") & (F.col("missing") == 0)
    all_done = status.where("status <> 'complete'").isEmpty()
    return rows.select(
        "node", F.when(hit, "recommended").otherwise(own).alias("reading_status"),
        F.when(hit & F.col("parents").isNull(), "root_ready").when(hit, "prerequisites_read").alias("reason"), F.lit(all_done).alias("ready"),
    )


def affected(reach: DataFrame, revised: DataFrame, reading: DataFrame) -> DataFrame:
    """Read nodes below a revised one."""
    below = reach.join(revised.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return below.join(reading.where("reading_status = 'read'").select("node"), "node", "left_semi")


#: The classes in which a node is shown, by its status, and once it is generated by what was read of it.
RIPENESS = {"failed": "blighted", "locked": "set", "ready": "unripe", "running": "turning"}
RIPENESS_READ = {"read": "picked", "recommended": "ripe", "reading": "ripe"}


def ripeness(status: DataFrame) -> DataFrame:
    """``(node, status, reading_status)`` -> ``(node, ripeness)``: one of seven classes."""
    out = F.lit("almost")
    for column, classes in (("reading_status", RIPENESS_READ), ("status", RIPENESS)):
        for value, kind in classes.items():
            out = F.when(F.col(column) == value, kind).otherwise(out)
    return status.select("node", out.alias("ripeness"))


def repeat_runs(events: DataFrame, *, key: str, order: list[str], value: str) -> DataFrame:
    """The number of equal values in a row up to each event (1 where the value changes)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    island = events.withColumn("island", F.sum(changed).over(w))
    return island.withColumn("run", F.row_number().over(Window.partitionBy(key, "island").orderBy(*order))).drop("island")


def repeated_reports(reports: DataFrame, *, key: str, order: list[str], text: str = "text", history: int = 20) -> DataFrame:
    """``reports`` with ``repeat_count``, how many reports up to this one each say the same as the one before (``similar_reports``), and ``history``: the last ones, this one included.

    A report is compared with the one just before it only; an empty or null one is like no other. ``order`` must tell a key's reports apart.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = reports.withColumn("__before", F.lag(text).over(w))
    rows = rows.withColumn("__new", F.when(T.similar_reports(F.col("__before"), F.col(text)), 0).otherwise(1)).drop("__before")
    rows = rows.withColumn("__stretch", F.sum("__new").over(w))
    count = F.row_number().over(Window.partitionBy(key, "__stretch").orderBy(*order))
    last = F.collect_list(F.coalesce(text, F.lit(""))).over(w.rowsBetween(1 - history, 0))
    return rows.withColumn("repeat_count", count).withColumn("history", last).drop("__new", "__stretch")
