"""Read views: the graph with all that is known of its nodes, stage rows, counts, and messages fit to be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of a run in their order, and the badge of each state.
STAGES = ["ocr", "clean", "cut", "embed", "cluster", "link", "noderun"]
FAILED_STATES = ["failed", "blocked", "error"]
ENDED_PHASES = ["blocked", "failed", "error"]


def output_paths(ledger: DataFrame) -> DataFrame:
    """``ledger(ord, node_ids, output_path)`` -> ``(node, paths)``: each node's outputs in the ledger's order."""
    rows = ledger.where(F.coalesce("output_path", F.lit("")) != "").select("ord", "output_path", F.explode("node_ids").alias("node"))
    return rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("ord", "output_path"))).alias("x")).select("node", F.transform("x", lambda r: r["output_path"]).alias("paths"))


def first_output(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """``(node, output_path)``: each node's first output that is among ``files(path)``."""
    rows = ledger.join(files.select(F.col("path").alias("output_path")), "output_path", "left_semi").select("ord", "output_path", F.explode("node_ids").alias("node"))
    return rows.groupBy("node").agg(F.min_by("output_path", "ord").alias("output_path"))


def graph_view(labels: DataFrame, status: DataFrame, edges: DataFrame, outputs: DataFrame, reading: DataFrame) -> DataFrame:
    """``labels(node, title, label)``, ``status(node, status)``, ``edges(src, dst)``, ``outputs(node, paths)``, ``reading(node, reading_status, reason, ready)``.

    -> one row for each node with all of these, its prerequisites and its dependents; lists are empty where there is nothing.
    """
    near = lambda own, other, name: edges.groupBy(F.col(own).alias("node")).agg(F.array_sort(F.collect_set(other)).alias(name))
    rows = labels.join(status, "node", "left").join(near("dst", "src", "prerequisites"), "node", "left").join(near("src", "dst", "dependents"), "node", "left")
    rows = rows.join(outputs, "node", "left").join(reading, "node", "left")
    kind = {f.name: f.dataType for f in rows.schema}
    lists = [F.coalesce(c, F.array().cast(kind[c])).alias(c) for c in ("prerequisites", "dependents", "paths")]
    return rows.select("node", "title", "label", "status", *lists, F.coalesce("reading_status", F.lit("unread")).alias("reading_status"), "reason", "ready")


def stage_rows(stages: DataFrame, errors: DataFrame, phase: Column) -> DataFrame:
    """``stages(project, stage, done, total, status, message, active)``, ``errors(project, ord, stage, resource, message)`` -> rows as they are shown.

    ``pct`` is rounded to even and within 0 and 100. In a phase that ended badly, stages with an error failed, and running ones are partial (if
    anything is done) or pending. ``current``: the last error's resource (or message), else the message, else what is active.
    """
    last = errors.where("stage <> ''").groupBy("project", "stage").agg(F.max_by(F.coalesce(F.nullif(F.col("resource"), F.lit("")), "message"), "ord").alias("error"), F.lit(True).alias("erred"))
    rows = stages.withColumn("ended", phase.isin(ENDED_PHASES)).join(last, ["project", "stage"], "left")
    running = F.col("status").isin("running", "in_progress", "active")
    status = F.when(F.col("ended") & F.col("erred"), "failed").when(F.col("ended") & running, F.when(F.col("done") > 0, "partial").otherwise("pending")).otherwise(F.col("status"))
    pct = F.when(F.col("total") > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("done") / F.col("total") * 100, 0)))).otherwise(0).cast("int")
    current = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.nullif(F.col("message"), F.lit("")), F.array_join("active", ", "))
    return rows.select("project", "stage", "done", "total", pct.alias("pct"), status.alias("status"), current.alias("current"))


def with_stage_defaults(stages: DataFrame, projects: DataFrame) -> DataFrame:
    """``stages(project, stage, done, total, status)`` with a row for every stage of every project: counts of 0 at least, 'pending' where nothing is known."""
    every = projects.select("project", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    rows = every.join(stages, ["project", "stage"], "left")
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    return rows.select("project", "stage", count("done"), count("total"), F.coalesce("status", F.lit("pending")).alias("status"))


def run_overview(executions: DataFrame, nodes: DataFrame, covered: DataFrame, running: DataFrame) -> DataFrame:
    """``executions(project, node, status)``, ``nodes(project, node)``, ``covered(project, node)``, ``running(project)`` -> one row for each project with nodes.

    How many nodes there are, are covered, completed and failed, how many are active (none unless the project runs), and whether all are covered.
    """
    count = lambda df, name: df.groupBy("project").agg(F.count_distinct("node").alias(name))
    rows = count(nodes, "nodes").join(count(nodes.join(covered, ["project", "node"], "left_semi"), "covered"), "project", "left")
    state = F.lower("status")
    runs = executions.groupBy("project").agg(F.count_if(state == "completed").alias("completed"), F.count_if(state.isin(FAILED_STATES)).alias("failed"), F.count_if(state == "in_progress").alias("open"))
    rows = rows.join(runs, "project", "left").join(running.select("project", F.lit(True).alias("runs")).distinct(), "project", "left").na.fill(0)
    return rows.select("project", "nodes", "covered", "completed", "failed", F.when(F.col("runs"), F.col("open")).otherwise(0).alias("active"), (F.col("covered") == F.col("nodes")).alias("all_covered"))


def failed_nodes(*lists: DataFrame) -> DataFrame:
    """The different nodes of several lists of failures."""
    out = lists[0].select("node")
    for more in lists[1:]:
        out = out.unionByName(more.select("node"))
    return out.where(F.col("node").isNotNull()).distinct()


def shown_errors(errors: DataFrame, resources: DataFrame) -> DataFrame:
    """``errors(project, ord, message)``, ``resources(project, resource)`` -> messages with each resource's path cut to its name, longer paths first."""
    paths = resources.where(F.trim("resource") != "").groupBy("project").agg(F.sort_array(F.collect_set(F.struct(F.length("resource").alias("n"), "resource")), asc=False).alias("paths"))
    rows = errors.join(paths, "project", "left")
    name = lambda r: F.element_at(F.split(F.replace(r["resource"], F.lit("\\"), F.lit("/")), "/"), -1)
    said = F.aggregate(F.coalesce("paths", F.array().cast("array<struct<n:int,resource:string>>")), F.col("message"), lambda acc, r: F.replace(acc, r["resource"], F.when(name(r) != "", name(r)).otherwise(r["resource"])))
    return rows.select("project", "ord", said.alias("message"))




def project_sizes(files: DataFrame) -> DataFrame:
    """``files(project, length)`` -> ``(project, files, bytes)``; the sum of sizes is 0 at least."""
    return files.groupBy("project").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def invalidated(before: Column, after: Column, stage_of: dict[str, str]) -> Column:
    """The stages to run anew when settings (maps) change: the earliest one that a changed setting bears on, and all behind it."""
    changed = F.filter(F.array(*map(F.lit, stage_of)), lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    place = F.create_map(*[F.lit(x) for k, s in stage_of.items() for x in (k, STAGES.index(s) + 1)])
    first = F.array_min(F.transform(changed, lambda k: place[k]))
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.array(*map(F.lit, STAGES)), first, len(STAGES)))
