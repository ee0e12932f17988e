"""Tables of what runs have done: ledgers, executions, imports, prompts and logs, each changed by joins on its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.sources.manifest import collection_of, upsert

#: States of a run that failed.
FAILED = ["failed", "blocked", "error"]
#: What marks a line of a log as an error, and what is only noise of a shutdown.
ERROR_SIGNS = ["traceback", "runtimeerror", "valueerror", "exception", "failed", " error", "error:", "blocked"]
SHUTDOWN_SIGNS = ["python is likely shutting down", "nameerror: name 'open' is not defined", "qdrantclient.__del__"]
#: Words that mark such noise only together.
SHUTDOWN_TOGETHER = ["qdrantclient", "sys.meta_path is none"]


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; each write adds files, none is changed."""
    events.write.mode("append").json(path)


def recent_events(spark: SparkSession, path: str, *, schema: str, limit: int = 20) -> DataFrame:
    """``(file, at, ...)``: the last ``limit`` objects of JSON-lines logs, in the order of files and of lines; lines that are no objects are passed over.

    The limit is of rows of all files together, and a task keeps no more than that.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where(F.col("value").rlike(r"^\s*\{")).select("file", "block", "at", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null")
    return rows.orderBy(F.desc("file"), F.desc("block"), F.desc("at")).limit(limit).select("file", "at", "e.*")


def log_errors(lines: DataFrame, *, tail: int = 80, last: int = 5) -> DataFrame:
    """``lines(file, at, line)`` -> the last ``last`` lines that look like errors, of the last ``tail`` lines of each file."""
    end = Window.partitionBy("file").orderBy(F.desc("at"))
    said = F.lower("line")
    sign = lambda words: F.greatest(*[said.contains(w) for w in words])
    rows = lines.withColumn("k", F.row_number().over(end)).where(F.col("k") <= tail).where(F.trim("line") != "").where(sign(ERROR_SIGNS) & ~sign(SHUTDOWN_SIGNS))
    rows = rows.where(~F.least(*[said.contains(w) for w in SHUTDOWN_TOGETHER]))
    return rows.orderBy(F.desc("file"), F.desc("at")).limit(last).select("file", "at", F.trim("line").alias("line"))


def split_generations(ledger: DataFrame, generation: str) -> tuple[DataFrame, DataFrame]:
    """The rows of one generation (or of none), and all others, which are archived."""
    own = F.coalesce("generation_id", F.lit("")).isin("", generation)
    return ledger.where(own), ledger.where(~own)


def staged_reindex(ledger: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edited(record, output_sha256)`` -> the edited records as they will be, and the ledger with them: the first is written before the index, the second after."""
    staged = ledger.drop("output_sha256").join(edited, "record").select(ledger.columns)
    return staged, upsert(ledger, staged, "record")


def after_events(executions: DataFrame, events: DataFrame) -> DataFrame:
    """``executions(node, status, mode, error)``, ``events(node, ord, kind, mode, error)`` -> executions after the last decisive event of each node.

    fail: failed, with its error; complete: completed; retry: in progress again if it had failed; reset: in progress, without mode and error. The mode
    is that of the first event that has one since the last reset, unless the execution has one already.
    """
    last = events.where(F.col("kind").isin("fail", "complete", "retry", "reset")).groupBy("node").agg(F.max_by(F.struct("kind", "error"), "ord").alias("e"), F.max(F.when(F.col("kind") == "reset", F.col("ord"))).alias("reset_at"))
    modes = events.where("mode is not null").join(last.select("node", "reset_at"), "node", "left").where(F.col("reset_at").isNull() | (F.col("ord") > F.col("reset_at")))
    modes = modes.groupBy("node").agg(F.min_by("mode", "ord").alias("new_mode"))
    rows = executions.join(last, "node", "left").join(modes, "node", "left")
    kind = F.col("e.kind")
    # A retry bears on what had failed: before it, or in the table.
    failed_before = events.where("kind = 'fail'").select("node", F.lit(True).alias("had_failed")).distinct()
    rows = rows.join(failed_before, "node", "left")
    again = F.lower("status").isin(FAILED) | F.coalesce("had_failed", F.lit(False))
    status = F.when(kind == "fail", "failed").when(kind == "complete", "completed").when(kind == "reset", "in_progress").when((kind == "retry") & again, "in_progress").otherwise(F.col("status"))
    error = F.when(kind == "fail", F.col("e.error")).when(kind.isin("reset", "retry"), F.lit(None)).otherwise(F.col("error"))
    mode = F.when(F.col("reset_at").isNull(), F.coalesce("mode", "new_mode")).otherwise(F.col("new_mode"))
    return rows.select("node", status.alias("status"), mode.alias("mode"), error.alias("error"))


def activities(events: DataFrame, stages: DataFrame) -> DataFrame:
    """``events(stage, ord, token, started)``, ``stages(stage, done, total, failed)`` -> ``(stage, active, status)``.

    Active are the tokens whose last event is a start. A failed stage stays so; one with active tokens runs; else it is complete if all is done, and pending if not.
    """
    last = events.groupBy("stage", "token").agg(F.max_by("started", "ord").alias("on"))
    active = last.where("on").groupBy("stage").agg(F.array_sort(F.collect_list("token")).alias("active"))
    rows = stages.join(active, "stage", "left")
    status = F.when(F.col("failed"), "failed").when(F.col("active").isNotNull(), "running").when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "complete").otherwise("pending")
    return rows.select("stage", F.coalesce("active", F.array().cast("array<string>")).alias("active"), status.alias("status"))


def with_last_entry(history: Column, at: Column, status: Column, error: Column) -> Column:
    """A history of (submitted_at, status, error) structs in which the last entry of a time has a new status and error."""
    n = F.size(history)
    place = n - F.array_position(F.reverse(F.transform(history, lambda h: h["submitted_at"])), at)
    there = F.exists(history, lambda h: h["submitted_at"] == at)
    return F.transform(history, lambda h, k: F.when(there & (k == place), F.struct(h["submitted_at"].alias("submitted_at"), status.alias("status"), error.alias("error"))).otherwise(h))


def imported_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(relative_path, original_name, sha256)``, ``files(relative_path, sha256)`` -> all that was imported (active or missing), and files no import tells of."""
    here = files.select("relative_path", F.col("sha256").alias("own"))
    rows = imports.join(here, "relative_path", "left").select(
        "relative_path", F.coalesce(F.nullif(F.col("original_name"), F.lit("")), F.element_at(F.split("relative_path", "/"), -1)).alias("original_name"),
        F.coalesce("sha256", F.lit("")).alias("sha256"), F.when(F.col("own").isNotNull(), "active").otherwise("missing").alias("status"),
    )
    more = here.join(imports.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("original_name"), F.col("own").alias("sha256"), F.lit("active").alias("status"))
    return rows.unionByName(more).withColumn("collection", collection_of(F.col("relative_path")))


def part_names(files: DataFrame) -> DataFrame:
    """``files(source_file, part, parts)`` -> ``name``: the file's own name if it is one part, else with the part's number."""
    return files.withColumn("name", F.when(F.col("parts") == 1, F.col("source_file")).otherwise(F.format_string("%s.part-%03d", F.col("source_file"), F.col("part"))))


def prompt_settings(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """``defaults(name, text)``, ``overrides(name, text, base_hash)`` -> ``(name, text, overridden, base_changed)``: the override where there is one, and whether it was made for another default."""
    mine = overrides.select("name", F.col("text").alias("own"), "base_hash", F.lit(True).alias("overridden"))
    rows = defaults.join(mine, "name", "left")
    changed = F.col("overridden") & (F.coalesce("base_hash", F.lit("")) != F.substring(F.sha2("text", 256), 1, 16))
    return rows.select("name", F.coalesce("own", "text").alias("text"), F.coalesce("overridden", F.lit(False)).alias("overridden"), F.coalesce(changed, F.lit(False)).alias("base_changed"))


def in_graph(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``state`` whose node is in the graph; all of them while the graph is empty."""
    if nodes.isEmpty():
        return state
    return state.join(nodes.select("node").distinct(), "node", "left_semi")


def safe_output(name: Column) -> Column:
    """Whether a name is that of a file right below the outputs: no path, no parent, no hidden file."""
    return (F.length(name) > 0) & ~name.rlike(r"[/\\\x00]") & ~name.startswith(".")


def save_table(rows: DataFrame, path: str, generation: str) -> None:
    """Writes ``rows`` as a generation of the table at ``path`` and then makes it the current one; readers see the old one until then."""
    rows.write.mode("overwrite").parquet(f"{path}/generation={generation}")
    rows.sparkSession.createDataFrame([(generation,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current generation of the table at ``path``."""
    generation = spark.read.text(f"{path}/_current").first()[0]
    return spark.read.schema(schema).parquet(f"{path}/generation={generation}")


def usage(events: DataFrame, by: str, counters: list[str]) -> DataFrame:
    """The sums of usage counters for each ``by``; missing ones are 0."""
    return events.groupBy(by).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
