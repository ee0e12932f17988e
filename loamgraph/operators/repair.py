"""Cut plans: cleaning proposed units, sorting them into valid and invalid ones, finding what is wrong, and applying repairs.

A unit is ``(source_id, idx, start_line, end_line, title, defines, summary, unit_kind)``; ``idx`` is its place in the plan, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import lines as L

#: The kinds of units, those that aren't concepts, the limits of a unit's fields, and words that mark units without defines of their own.
KINDS = ["concept", "exercise", "application", "review", "summary", "intro"]
AUXILIARY = ["application", "exercise", "excercise", "review", "summary", "intro"]
MOST_DEFINES, TITLE_WIDTH, SUMMARY_WIDTH = 4, 40, 150
MARKERS = ["例题", "习题", "练习", "应用", "案例", "示例", "举例", "题解", "example", "exercise", "application", "case", "practice", "problem"]


def unit_problem(line_count: Column) -> Column:
    """The first rule that a raw unit breaks, null if none: its lines are numbers, its defines are few enough, its lines are within the source and in order."""
    start, end = F.expr("try_cast(start_line AS int)"), F.expr("try_cast(end_line AS int)")
    return (
        F.when(start.isNull(), "start_line").when(end.isNull(), "end_line").when(F.size(T.concepts(F.when(F.size("defines") > MOST_DEFINES, F.col("defines")))) > MOST_DEFINES, "defines")
        .when((start < 1) | (end > line_count), "out_of_bounds").when(end < start, "inverted")
    )


def normalized_units(raw: DataFrame) -> DataFrame:
    """Raw units (lines as texts) with cleaned fields: titles and summaries within their width and never blank, distinct defines, known kinds."""
    title = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.format_string("教学单元 %d", F.col("idx")))
    kind = F.lower(T.strip(F.col("unit_kind")))
    kind = F.when(kind == "excercise", "exercise").when(kind.isin(KINDS), kind).otherwise("concept")
    rows = raw.withColumn("title", T.cut_to_width(title, TITLE_WIDTH))
    rows = rows.withColumn("summary", T.cut_to_width(F.coalesce(F.nullif(T.strip(F.col("summary")), F.lit("")), F.col("title")), SUMMARY_WIDTH))
    return rows.withColumn("unit_kind", kind).withColumn("defines", T.concepts(F.col("defines"))).withColumn("start_line", F.expr("try_cast(start_line AS int)")).withColumn("end_line", F.expr("try_cast(end_line AS int)"))


def partition(raw: DataFrame, line_counts: DataFrame) -> DataFrame:
    """``raw`` units, ``line_counts(source_id, line_count)`` -> cleaned units with ``problem`` and ``valid``.

    A unit whose only fault is its metadata (too many defines) keeps its place among the valid ones, without defines.
    """
    rows = raw.join(line_counts, "source_id").withColumn("problem", unit_problem(F.col("line_count")))
    start, end = F.expr("try_cast(start_line AS int)"), F.expr("try_cast(end_line AS int)")
    placed = (F.col("problem") == "defines") & (start >= 1) & (end <= F.col("line_count")) & (start <= end)
    rows = rows.withColumn("valid", F.col("problem").isNull() | placed)
    return normalized_units(rows).withColumn("defines", F.when(F.col("problem") == "defines", F.array().cast("array<string>")).otherwise(F.col("defines"))).drop("line_count")


def _keys(defines: Column) -> Column:
    """The different keys of a unit's defines, without ''."""
    return F.array_remove(F.array_distinct(F.transform(defines, lambda d: T.text_key(d, unicode=False))), "")


def semantic_problems(units: DataFrame) -> DataFrame:
    """Valid units -> ``(source_id, kind, key, units)``: concepts without defines; in sources without any, keys that several concepts define.

    ``units`` holds the (start_line, end_line, title) of the units in question, in order; ``key`` is '' where it says nothing. The units are gone over once, and all steps are by source.
    """
    none = F.size("defines") == 0
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line", "title")
    rows = units.where("unit_kind = 'concept'").select("source_id", "start_line", "end_line", "title", none.alias("none"), F.when(none, F.array(F.lit(""))).otherwise(_keys(F.col("defines"))).alias("keys"))
    rows = rows.withColumn("bare", F.max("none").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("n", F.row_number().over(w)).where("none or not coalesce(bare, false)")
    rows = rows.select("source_id", F.struct("start_line", "end_line", "title").alias("place"), F.coalesce("none", F.lit(False)).alias("none"), F.when(F.col("none"), F.col("n")).alias("own"), F.explode("keys").alias("key"))
    found = rows.groupBy("source_id", "none", "own", "key").agg(F.array_sort(F.collect_list("place")).alias("units")).where("none or size(units) > 1")
    return found.select("source_id", F.when(F.col("none"), "empty_defines").otherwise("duplicate_defines").alias("kind"), "key", "units")


def _placed(parts: DataFrame) -> DataFrame:
    """``partition`` rows with ``reach``, the furthest end of the valid units before a valid one, and ``prev_end``, the end of the one just before it."""
    w = Window.partitionBy("source_id", "valid").orderBy("start_line", "end_line")
    return parts.withColumn("reach", F.coalesce(F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("prev_end", F.lag("end_line").over(w))


def repair_stage(parts: DataFrame, line_counts: DataFrame) -> DataFrame:
    """``partition`` rows -> ``(source_id, stage)``: what has to be repaired first, 'coverage', then 'metadata'; null if nothing has.

    Coverage: a unit whose lines are wrong, a gap, or an overlap. Metadata: other invalid units, or a semantic problem. The units are gone over once, and all steps are by source.
    """
    concept = F.col("valid") & (F.col("unit_kind") == "concept")
    lines = (F.col("problem") != "defines") | (F.col("valid") & ((F.col("start_line") > F.col("reach") + 1) | (F.col("start_line") <= F.col("prev_end"))))
    fields = (F.col("problem") == "defines") | (concept & (F.size("defines") == 0))
    rows = _placed(parts.select("source_id", "start_line", "end_line", "unit_kind", "defines", "problem", "valid"))
    rows = rows.select("source_id", F.when(F.col("valid"), F.col("end_line")).alias("end"), lines.alias("lines"), fields.alias("fields"), F.explode_outer(F.when(concept, _keys(F.col("defines")))).alias("key"))
    rows = rows.groupBy("source_id", "key").agg(F.max("end").alias("end"), F.max("lines").alias("lines"), F.max("fields").alias("fields"), (F.count("key") > 1).alias("twice"))
    rows = rows.groupBy("source_id").agg(F.max("end").alias("end"), F.max("lines").alias("lines"), F.max(F.coalesce("fields", F.lit(False)) | F.col("twice")).alias("fields"))
    tail = F.col("line_count") > F.coalesce("end", F.lit(0))
    return line_counts.join(rows, "source_id", "left").select("source_id", F.when(F.col("lines") | tail, "coverage").when(F.col("fields"), "metadata").alias("stage"))


def partition_summary(parts: DataFrame, line_counts: DataFrame, *, first: int = 3) -> DataFrame:
    """``(source_id, summary)``: the first so many invalid units, gaps and overlaps of each source, as one text; '' if there are none.

    The units are gone over once, and all steps are by source; the gap behind the last unit comes last.
    """
    start, end = F.col("start_line"), F.col("end_line")
    said = lambda when, kind, at, text: F.when(when, F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("said")))
    span = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    found = F.array(
        said(~F.col("valid"), "invalid", F.col("idx"), F.concat_ws(":", F.col("idx").cast("string"), "problem")),
        said(F.col("valid") & (start > F.col("reach") + 1), "missing", F.col("reach") + 1, span(F.col("reach") + 1, start - 1)),
        said(F.col("valid") & (start <= F.col("prev_end")), "overlap", start, span(start, F.least(end, F.col("prev_end")))),
    )
    rows = _placed(parts.select("source_id", "idx", "start_line", "end_line", "problem", "valid"))
    rows = rows.select("source_id", F.when(F.col("valid"), end).alias("end"), F.explode_outer(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("source_id", "end", "x.*")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id", "kind").orderBy("at", "said")))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("k") <= first), F.struct("k", "said")))), lambda r: r["said"]).alias(kind)
    rows = line_counts.join(rows.groupBy("source_id").agg(F.max("end").alias("end"), *map(of, ("invalid", "missing", "overlap"))), "source_id", "left")
    reach, none = F.coalesce("end", F.lit(0)), F.array().cast("array<string>")
    tail = F.when(F.col("line_count") > reach, F.array(span(reach + 1, F.col("line_count")))).otherwise(none)
    kinds = {"invalid": F.col("invalid"), "missing": F.slice(F.concat(F.coalesce("missing", none), tail), 1, first), "overlap": F.col("overlap")}
    whole = F.concat_ws("; ", *[F.when(F.size(x) > 0, F.concat(F.lit(f"{kind}="), F.array_join(x, ", "))) for kind, x in kinds.items()])
    return rows.select("source_id", whole.alias("summary"))


def is_auxiliary(defines: Column, kind: Column, title: Column, summary: Column) -> Column:
    """Whether a unit without defines serves another one: by its kind, or by a word in its title or summary."""
    said = F.lower(F.concat_ws(" ", title, summary))
    return (F.size(defines) == 0) & (F.lower(T.strip(kind)).isin(AUXILIARY) | said.rlike("|".join(MARKERS)))


def mergeable(units: DataFrame, problems: DataFrame) -> DataFrame:
    """``problems(source_id, kind, start_line, end_line, title)`` with ``mergeable``: short units are, and units without defines that serve another."""
    key = ["source_id", "start_line", "end_line", "title"]
    own = units.select(*key, is_auxiliary(F.col("defines"), F.col("unit_kind"), F.col("title"), F.col("summary")).alias("serves")).groupBy(*key).agg(F.max("serves").alias("serves"))
    rows = problems.join(own, key, "left")
    return rows.withColumn("mergeable", (F.col("kind") == "short_unit") | ((F.col("kind") == "empty_defines") & F.coalesce("serves", F.lit(False)))).drop("serves")


def merged_into_concepts(units: DataFrame, problems: DataFrame) -> DataFrame:
    """``units`` without those of ``problems``: each has gone into the nearest concept before it, or behind it if there is none before.

    The concept before a unit then reaches to its end, the one behind it from its start. Concepts that are problems themselves take nothing in; a
    unit without any concept stays. What goes into one concept is the furthest end and the earliest start, whatever the order of merging.
    """
    key = ["source_id", "start_line", "end_line", "title"]
    gone = problems.select(*key, F.lit(True).alias("gone")).distinct()
    rows = units.join(gone, key, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line", "title")
    own = F.when((F.col("unit_kind") == "concept") & ~F.col("gone"), F.struct("start_line", "end_line", "title"))
    before, after = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("to", F.when(F.col("gone"), F.coalesce(before, after))).withColumn("back", F.when(F.col("gone"), before.isNotNull()))
    taken = rows.where("gone and to is not null").groupBy("source_id", "to").agg(F.max(F.when(F.col("back"), F.col("end_line"))).alias("last"), F.min(F.when(~F.col("back"), F.col("start_line"))).alias("first"))
    stay = rows.where("not gone or to is null").withColumn("to", F.struct("start_line", "end_line", "title")).join(taken, ["source_id", "to"], "left")
    stay = stay.withColumn("start_line", F.least("start_line", F.coalesce("first", "start_line"))).withColumn("end_line", F.greatest("end_line", F.coalesce("last", "end_line")))
    return stay.select(*units.columns)


def replaced_by_range(units: DataFrame, repairs: DataFrame) -> DataFrame:
    """``units`` with those of a repaired range replaced; ``repairs``: units with ``old_start`` and ``old_end``. Repairs of ranges that aren't there are added."""
    gone = repairs.select("source_id", F.col("old_start").alias("start_line"), F.col("old_end").alias("end_line")).distinct()
    return units.join(gone, ["source_id", "start_line", "end_line"], "left_anti").unionByName(repairs.drop("old_start", "old_end"))


def define_repair_problems(repairs: DataFrame, expected: DataFrame) -> DataFrame:
    """``repairs``, ``expected`` ``(source_id, start_line, end_line, ...)`` -> ``(source_id, problem)`` for each source, null if its repair is in order.

    In this order: exactly the expected ranges come back, each as often; each has one to MOST_DEFINES defines; no key is left that two of them define.
    """
    key = ["source_id", "start_line", "end_line"]
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = count(repairs, "got").join(count(expected, "want"), key, "full_outer")
    ranges = both.groupBy("source_id").agg(F.bool_or(~F.col("got").eqNullSafe(F.col("want"))).alias("ranges"))
    n = F.coalesce(F.size("defines"), F.lit(0))
    sizes = repairs.groupBy("source_id").agg(F.bool_or(n <= 0).alias("none"), F.bool_or(n > MOST_DEFINES).alias("many"))
    keys = repairs.select("source_id", "start_line", "end_line", F.explode(F.array_distinct(F.transform("defines", lambda d: T.text_key(d, unicode=False)))).alias("define")).where("define <> ''")
    twice = keys.groupBy("source_id", "define").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit(True).alias("twice")).distinct()
    rows = ranges.join(sizes, "source_id", "left").join(twice, "source_id", "left")
    return rows.select("source_id", F.when(F.col("ranges"), "ranges").when(F.col("none"), "no_defines").when(F.col("many"), "too_many_defines").when(F.col("twice"), "duplicate_defines").alias("problem"))


def window_tiling(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows(source_id, window_start, window_end)`` -> ``(source_id, problem)``: the first thing that keeps spans from covering a window exactly once, or 'ok'."""
    w = Window.partitionBy("source_id").orderBy("start_line", "end_line")
    rows = spans.join(windows, "source_id").withColumn("ord", F.row_number().over(w)).withColumn("expected", F.coalesce(F.lag("end_line").over(w) + 1, F.col("window_start")))
    problem = (
        F.when((F.col("start_line") < F.col("window_start")) | (F.col("end_line") > F.col("window_end")), "outside").when(F.col("end_line") < F.col("start_line"), "inverted")
        .when(F.col("start_line") < F.col("expected"), "overlap").when(F.col("start_line") > F.col("expected"), "gap")
    )
    found = rows.withColumn("problem", problem).groupBy("source_id").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("ord"))).alias("problem"), F.max("end_line").alias("last"))
    rows = windows.join(found, "source_id", "left")
    return rows.select("source_id", F.coalesce("problem", F.when(F.coalesce("last", F.col("window_start") - 1) < F.col("window_end"), "gap"), F.lit("ok")).alias("problem"))
