"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.stages import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``, the component being its smallest node.

    Each round hooks every neighbour of a node to the least node around it, first the larger
    neighbours (large star), then the smaller ones (small star); the table never outgrows the
    edges, and the number of rounds is logarithmic in the longest path. Each round is stored,
    so that a lost executor repeats one round only. Minima are combined before the shuffle,
    and the joins are plain equi joins, which adaptive execution splits at hot nodes.

    Self loops, repeated edges and edges with a null end are ignored; nodes without an edge
    don't appear. An empty table gives an empty table.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, seen = stored(e, "edges"), None
    for _ in range(max_rounds):
        state = _state(e)
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = stored(small.select("e.*").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    labelled = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labelled.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
