"""The prerequisite graph of a set of units: nodes from claims, edges from what nodes require, without cycles and without implied edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamgraph.functions import text as T
from loamgraph.operators import graph as G
from loamgraph.operators import nodes as N
from loamgraph.operators import parts as A
from loamgraph.sources.stages import stored


def judged_edges(edges: DataFrame, repairs: DataFrame | None = None, *, part: str | None = None) -> DataFrame:
    """``edges(src, dst, confidence)`` -> ``(src, dst, verdict)``: 'repaired' edges that ``repairs(src, dst)`` takes away, 'cycle' edges that close one, 'implied' edges that others replace, and those that are 'kept'.

    Where ``part`` names a column that both ends of an edge share, small parts are judged whole in tasks (``parts``).
    """
    if part:
        small, large, bundles = A.split(edges, part)
        gone = F.lit(False) if repairs is None else F.coalesce("repaired", F.lit(False))
        marked = small if repairs is None else small.join(repairs.select("src", "dst", F.lit(True).alias("repaired")).distinct(), ["src", "dst"], "left")
        schema = StructType([*A.ends(edges), StructField("verdict", StringType())])
        found = A.worked_out(marked.withColumn("repaired", gone), part, bundles, A.judged, ["src", "dst", "confidence", "repaired"], schema)
        return found if large is None else found.unionByName(judged_edges(large, repairs))
    left = edges if repairs is None else edges.join(repairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    acyclic = stored(G.break_cycles(left).select("src", "dst").distinct(), "acyclic")
    kept = stored(G.reduction(acyclic), "reduced")
    mark = lambda df, name: df.select("src", "dst", F.lit(True).alias(name)).distinct()
    rows = edges.select("src", "dst").distinct().join(mark(kept, "kept"), ["src", "dst"], "left").join(mark(acyclic, "acyclic"), ["src", "dst"], "left").join(mark(left, "left"), ["src", "dst"], "left")
    return rows.select("src", "dst", F.when(F.col("kept"), "kept").when(F.col("acyclic"), "implied").when(F.col("left"), "cycle").otherwise("repaired").alias("verdict"))


@dataclass(frozen=True)
class Graph:
    """``nodes(node, ord, title, members, collections, defines)``, ``edges(src, dst, required)``, ``roots(node)`` and ``diagnostics(code, subject)``."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    diagnostics: DataFrame


def build_graph(units: DataFrame, raw: DataFrame, required: DataFrame) -> Graph:
    """``units(unit, ord, collection, title, defines)``, ``raw(ord, title, members, defines)``, ``required(title, defines)`` -> the graph.

    Proposed nodes of one title are one; a unit belongs to the first node that lists it, and one that none lists is a node by itself. A node requires
    those that define what its prerequisites name, by text keys. Units and proposals may be empty.
    """
    raw = raw.withColumn("title", T.strip(F.coalesce("title", F.lit(""))))
    merged = stored(N.merge_by_title(raw, T.text_key(F.col("title"))), "raw-nodes")
    claims = merged.select(F.col("ord").alias("node_ord"), F.explode("members").alias("unit"))
    members, free = N.first_claims(claims, units.select("unit"))
    own = units.select("unit", "ord", "collection", "title")
    named = N.node_ids(members, own).drop("title").join(merged.select(F.col("ord").alias("node_ord"), "title", "defines"), "node_ord")
    alone = free.join(units, "unit").select(F.col("ord").cast(claims.schema["node_ord"].dataType).alias("node_ord"), "unit")
    single = N.node_ids(alone, own).join(units.select(F.col("unit").cast("string").alias("u"), "defines"), F.col("members")[0] == F.col("u")).drop("u")
    columns = ["node", "ord", "title", "members", "collections", "defines"]
    nodes = stored(named.select(columns).unionByName(single.select(columns)).withColumn("defines", T.concepts(F.col("defines"))), "nodes")
    key = T.text_key(F.col("define"))
    definers = stored(nodes.select("node", F.explode("defines").alias("define")).select("node", key.alias("key")).where("key <> ''").distinct(), "definers")
    titles = nodes.groupBy(T.text_key(F.col("title")).alias("title_key")).agg(F.max_by("node", F.struct("ord", "node")).alias("node"))
    need = stored(required.select(T.text_key(F.col("title")).alias("title_key"), F.posexplode("defines").alias("pos", "define")).join(titles, "title_key").select("node", "pos", key.alias("key")), "need")
    edges = stored(G.edges_from_requirements(definers, need), "requirements")
    verdicts = stored(judged_edges(edges.select("src", "dst", F.lit(1.0).alias("confidence"))), "verdicts")
    kept = edges.join(verdicts.where("verdict = 'kept'").select("src", "dst"), ["src", "dst"])
    twice = N.duplicate_defines(definers.join(nodes.select("node", "ord"), "node")).select(F.lit("duplicate_define").alias("code"), F.col("key").alias("subject"))
    said = free.select(F.lit("mtu_unassigned").alias("code"), F.col("unit").cast("string").alias("subject")).unionByName(twice.distinct())
    said = said.unionByName(verdicts.where("verdict = 'cycle'").select(F.lit("cycle_edges_removed").alias("code"), F.concat_ws(" -> ", "src", "dst").alias("subject")))
    return Graph(nodes, kept, G.roots(nodes.select("node"), kept), said)
