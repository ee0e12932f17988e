"""What a node's text is written from: source chunks, retrieved hits, traces of sources, and the node's neighbours in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import similarity as S


def source_evidence(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``wanted(node, unit)``, ``chunks(unit, chunk_index, chunk_id, text)`` -> each wanted unit's first chunk, as ``(node, unit, chunk_id, text)``; null where it has none."""
    first = chunks.groupBy("unit").agg(F.min_by(F.struct("chunk_id", "text"), F.struct("chunk_index", "chunk_id")).alias("c"))
    return wanted.select("node", "unit").distinct().join(first, "unit", "left").select("node", "unit", "c.chunk_id", "c.text")


def deduped_hits(required: DataFrame, semantic: DataFrame) -> DataFrame:
    """``(node, ord, chunk_id, unit, text)`` of both -> hits with ``place``: the required ones before the others, each chunk at its first place only.

    Hits without a chunk are told apart by their units, those without one by their texts; hits with none of these go.
    """
    rows = required.withColumn("group", F.lit(0)).unionByName(semantic.withColumn("group", F.lit(1)))
    key = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("chunk_id", "unit", "text")])
    rows = rows.withColumn("key", key).where("key is not null").groupBy("node", "key").agg(F.min(F.struct("group", "ord", "chunk_id", "unit", "text")).alias("h")).select("node", "h.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("group", "ord"))).drop("group", "ord")


def missing_evidence(members: DataFrame, hits: DataFrame) -> DataFrame:
    """``(node, unit)`` of members that no hit of their node is of."""
    return members.select("node", "unit").distinct().join(hits.select("node", "unit").distinct(), ["node", "unit"], "left_anti")


#: The head of the section that names a text's sources, its lines, and what stands for unknown lines.
TRACE_HEAD, TRACE_LINE, TRACE_RANGE, TRACE_UNKNOWN = "## 来源追溯", "- `%s`，%s（`%s`）", "第 %d–%d 行", "行范围未知"


def source_trace(members: DataFrame, units: DataFrame) -> DataFrame:
    """``members(node, pos, unit)``, ``units(unit, source, start_line, end_line)`` -> ``(node, trace, missing)``: each node's sources as a Markdown section, and its unknown units."""
    rows = members.join(units.withColumn("known", F.lit(True)), "unit", "left")
    name = F.element_at(F.split(F.replace("source", F.lit("\\"), F.lit("/")), "/"), -1)
    span = F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.format_string(TRACE_RANGE, F.col("start_line"), F.col("end_line"))).otherwise(TRACE_UNKNOWN)
    line = F.format_string(TRACE_LINE, F.coalesce(F.nullif(name, F.lit("")), "source"), span, F.col("unit").cast("string"))
    found = rows.groupBy("node").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", line.alias("line"))))).alias("lines"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("unit")))).alias("missing")
    )
    text = F.array_join(F.concat(F.array(F.lit(TRACE_HEAD), F.lit("")), F.transform("lines", lambda x: x["line"])), "\n")
    return found.select("node", text.alias("trace"), "missing")


#: The section that names what a text builds on.
PREAMBLE_HEAD, PREAMBLE_LINKS, PREAMBLE_NONE, PREAMBLE_EXTERNAL = "## 先修前置", "本节点由 DAG 判定需要先掌握以下已完成节点：", "本节点无材料内先修节点。", "材料外基础："


def draft_preamble(nodes: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """``nodes(node, ord, seq, title, defines, external)``, ``edges(src, dst, required)``, ``ledger(ord, node, output_path)`` -> ``(node, preamble)``.

    Title, then each parent in its order, linked to its first output, with what is required of it (its own defines if the edge names none), then what is
    needed from outside the material.
    """
    link = ledger.groupBy("node").agg(F.min_by("output_path", "ord").alias("path"))
    parents = nodes.select(F.col("node").alias("src"), F.col("ord").alias("p_ord"), F.col("title").alias("p_title"), F.col("defines").alias("p_defines"))
    rows = edges.join(parents, "src", "left").join(link.withColumnRenamed("node", "src"), "src", "left")
    name = F.coalesce("p_title", F.col("src").cast("string"))
    to = F.regexp_replace("path", "^outputs/", "")
    label = F.when(F.coalesce(to, F.lit("")) != "", F.format_string("[%s](%s)", name, to)).otherwise(name)
    need = F.filter(F.when(F.size("required") > 0, F.col("required")).otherwise(F.coalesce("p_defines", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    line = F.when(F.size(need) > 0, F.format_string("- %s：相关先修 defines：%s。", label, F.array_join(need, "、"))).otherwise(F.format_string("- %s。", label))
    lines = rows.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("p_ord", F.lit(0)).alias("p_ord"), "src", line.alias("line")))).alias("x"))
    rows = nodes.join(lines, "node", "left")
    own = F.when(F.col("x").isNull(), F.array(F.lit(PREAMBLE_NONE))).otherwise(F.concat(F.array(F.lit(PREAMBLE_LINKS)), F.transform("x", lambda r: r["line"])))
    outside = F.when(F.size("external") > 0, F.concat(F.array(F.lit(""), F.lit(PREAMBLE_EXTERNAL)), F.transform("external", lambda e: F.concat(F.lit("- "), e)))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("# "), F.col("seq"), F.lit(". "), T.clean_title(F.col("title"))), F.lit(""), F.lit(PREAMBLE_HEAD), F.lit(""))
    return rows.select("node", T.strip(F.array_join(F.concat(head, own, outside), "\n")).alias("preamble"))


def retrieved(hits: DataFrame, *, group: str, total: int = 96_000, each: int = 24_000, marker: str = "\n\n[... hit %d cut to fit ...]\n\n") -> DataFrame:
    """``hits(group, place, path, filename, doc_id, content_kind, text)`` -> hits with ``hit`` (from 1), ``source``, the ``text`` as it fits the budget of characters, and its length ``taken``.

    ``source`` is the first of path, file name, document and 'unknown'. Hits are taken by place; a text is cut to ``each`` characters, and to what is left of
    ``total``, by leaving out its middle (``bounded_text``; ``marker`` with the number of the hit stands there). Hits for which nothing is left go. A null text is empty.
    """
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = hits.withColumn("source", F.coalesce(some("path"), some("filename"), some("doc_id"), F.lit("unknown"))).withColumn("content_kind", F.coalesce(some("content_kind"), F.lit("unknown")))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    by_place = Window.partitionBy(group).orderBy("place")
    used = F.coalesce(F.sum(F.least(F.length("text"), F.lit(each))).over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).withColumn("hit", F.row_number().over(by_place)).where(F.col("used") < total)
    most = F.least(F.lit(each), F.lit(total) - F.col("used")).cast("int")
    return rows.withColumn("text", S.bounded_text(F.col("text"), most, marker=F.format_string(marker, F.col("hit")))).withColumn("taken", F.length("text")).drop("used")


def node_context(targets: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """``targets(node)`` -> ``(node, parents, visible, future, n_siblings)``: direct parents, covered ancestors, descendants, and how many nodes are none of these.

    ``ancestors``, ``descendants``: ``(node, other)``. Siblings are counted, as they are nearly all nodes; ``is_sibling`` tells of a pair.
    """
    of = lambda df, name: df.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias(name))
    parents = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    total = nodes.select("node").distinct().agg(F.count("*").alias("total"))
    none = F.array().cast(f"array<{nodes.schema['node'].dataType.simpleString()}>")
    rows = targets.select("node").join(of(parents, "parents"), "node", "left").join(of(ancestors, "visible"), "node", "left").join(of(descendants, "future"), "node", "left")
    rows = rows.select("node", *[F.coalesce(c, none).alias(c) for c in ("parents", "visible", "future")]).join(F.broadcast(total))  # one row
    held = F.array_union(F.array_union("visible", "future"), F.array("node"))
    return rows.select("node", "parents", "visible", "future", (F.col("total") - F.size(held)).alias("n_siblings"))


def is_sibling(node: Column, other: Column, visible: Column, future: Column) -> Column:
    return (node != other) & ~F.array_contains(visible, other) & ~F.array_contains(future, other)


def prior_outputs(ledger: DataFrame, visible: DataFrame, files: DataFrame) -> DataFrame:
    """``ledger(record, node_ids, output_path)``, ``visible(node, other)``, ``files(path)`` -> ``(node, output_path)``: outputs that are there, of which all nodes are visible to the node."""
    own = ledger.where(F.size("node_ids") > 0).join(files.select(F.col("path").alias("output_path")), "output_path", "left_semi")
    own = own.select("record", "output_path", F.size(F.array_distinct("node_ids")).alias("n"), F.explode(F.array_distinct("node_ids")).alias("other"))
    seen = own.join(visible.select("node", "other").distinct(), "other").groupBy("node", "record", "output_path", "n").agg(F.count("*").alias("seen"))
    return seen.where("seen = n").select("node", "output_path").distinct()
