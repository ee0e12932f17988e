"""Knowledge nodes: claims, merging, define conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.ids import prefixed_id
from loamgraph.operators.ordering import numbered_within
from loamgraph.sources.stages import stored


def first_claims(claims: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims(node_ord, unit)``, ``units(unit)`` -> members ``(node_ord, unit)`` and units no node claims.

    A unit belongs to the first node that lists it; unknown units go, and so do nodes left without any.
    """
    first = claims.join(units.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.min("node_ord").alias("node_ord"))
    return first.select("node_ord", "unit"), units.select("unit").join(claims, "unit", "left_anti")


def merge_by_title(raw: DataFrame, title_key: Column) -> DataFrame:
    """``raw(ord, title, members, defines)`` with equal titles put together in order; the first title's spelling stays, blank ones go."""
    rows = raw.withColumn("key", title_key).where("key <> ''")
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "members", "defines"))).alias("x"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("x", lambda r: r[c])))
    return rows.select(F.col("x")[0]["ord"].alias("ord"), F.col("x")[0]["title"].alias("title"), flat("members").alias("members"), flat("defines").alias("defines"))


def nearest_with_defines(nodes: DataFrame) -> DataFrame:
    """``nodes(collection, ord, node, n_defines)`` -> ``target``: the nearest node with defines before a node without any, else behind it."""
    w = Window.partitionBy("collection").orderBy("ord", "node")
    own = F.when(F.col("n_defines") > 0, F.col("node"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return nodes.withColumn("target", F.when(F.col("n_defines") > 0, F.col("node")).otherwise(F.coalesce(before, after, F.col("node"))))


def duplicate_defines(defines: DataFrame) -> DataFrame:
    """``defines(node, ord, key)`` -> ``(key, holder, node)``: nodes with a key that an earlier node holds."""
    holder = defines.where("key <> ''").groupBy("key").agg(F.min_by("node", F.struct("ord", "node")).alias("holder"))
    return defines.join(holder, "key").where("node <> holder").select("key", "holder", "node").distinct()


def contained(shorter: Column, longer: Column) -> Column:
    """Whether a key names the same concept as a longer one that contains it: four characters and 0.55 of its length at
    least, unless the longer one speaks of something of it (has the possessive 的 between two texts)."""
    return (F.length(shorter) >= 4) & (F.length(shorter) >= 0.55 * F.length(longer)) & longer.contains(shorter) & ~longer.rlike(r"(?s)^[^的]+的.+$")


def contained_keys(keys: DataFrame) -> DataFrame:
    """``keys(key)`` -> the distinct ``(short_key, long_key)`` that ``contained`` holds of.

    A key of n characters can only be contained in one of n / 0.55 at most. Keys are therefore cut into their windows of the
    lengths that shorter keys may have, and those are looked up by equality; no pair of keys is tried in vain.
    """
    keys = keys.select("key").where(F.length("key") >= 4).distinct()
    n = F.length("key")
    low = F.greatest(F.lit(4), F.ceil(n * 0.55)).cast("int")
    sizes = keys.where(n > low - 1).select("key", F.explode(F.sequence(low, n)).alias("size")).where(F.col("size") < F.length("key"))
    windows = sizes.select(F.col("key").alias("long_key"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - F.col("size") + 1), lambda i: F.substring("key", i, F.col("size")))).alias("key")).distinct()
    return windows.join(keys, "key").where(contained(F.col("key"), F.col("long_key"))).select(F.col("key").alias("short_key"), "long_key")


def contained_defines(defines: DataFrame) -> DataFrame:
    """``defines(node, key)`` -> ``(short_key, long_key, node, other)`` for keys of different nodes that ``contained`` holds of; keys of many nodes
    give the product of these, which ``contained_counts`` counts without its rows."""
    left = defines.select("node", F.col("key").alias("short_key"))
    right = defines.select(F.col("node").alias("other"), F.col("key").alias("long_key"))
    return contained_keys(defines).join(left, "short_key").join(right, "long_key").where("node <> other").select("short_key", "long_key", "node", "other").distinct()


def contained_counts(defines: DataFrame) -> DataFrame:
    """``defines(node, key)`` -> ``(short_key, long_key, pairs)``: how many rows ``contained_defines`` has of two keys, if any.

    They are the product of the keys' nodes without the nodes that have both, so rows grow with the defines and not with that product.
    """
    own = defines.select("node", "key").where("node is not null").distinct()
    held = own.groupBy("key").agg(F.count("*").alias("n"))
    keys = stored(contained_keys(held), "contained-keys")
    both = own.select("node", F.col("key").alias("short_key")).join(keys.select("short_key").distinct(), "short_key", "left_semi").join(own.select("node", F.col("key").alias("long_key")), "node")
    both = both.where(F.length("short_key") < F.length("long_key")).groupBy("short_key", "long_key").agg(F.count("*").alias("both"))
    rows = keys.join(held.select(F.col("key").alias("short_key"), F.col("n").alias("shorts")), "short_key").join(held.select(F.col("key").alias("long_key"), F.col("n").alias("longs")), "long_key").join(both, ["short_key", "long_key"], "left")
    return rows.select("short_key", "long_key", (F.col("shorts") * F.col("longs") - F.coalesce("both", F.lit(0))).alias("pairs")).where("pairs > 0")


def batches(units: DataFrame, *, limit: int) -> DataFrame:
    """``batch`` of each unit: so many units of a collection at a time, in order."""
    return numbered_within(units, "collection", "ord").withColumn("batch", F.floor((F.col("rank") - 1) / limit).cast("int")).drop("rank")


def node_ids(members: DataFrame, units: DataFrame) -> DataFrame:
    """``members(node_ord, unit)``, ``units(unit, ord, collection, title)`` -> ``(node_ord, node, members, collections, ord, title)``.

    A node's id is a hash of its sorted members; its place is that of its first unit, its collections are theirs, and its title is that of the
    first unit unless it has one of its own. Members of one node are one row, as its id is a hash of them.
    """
    rows = members.join(units, "unit").groupBy("node_ord").agg(
        F.array_sort(F.collect_list(F.col("unit").cast("string"))).alias("members"), F.array_sort(F.collect_set("collection")).alias("collections"),
        F.min("ord").alias("ord"), F.min_by("title", F.struct("ord", "unit")).alias("title"),
    )
    return rows.select("node_ord", prefixed_id("kn", F.array_join("members", "|")).alias("node"), "members", "collections", "ord", "title")


def define_dictionary(nodes: DataFrame) -> DataFrame:
    """``nodes(node, ord, define)`` -> ``(define, defined_by)``: each define's nodes in their order."""
    rows = nodes.groupBy("define").agg(F.array_sort(F.collect_list(F.struct("ord", "node"))).alias("x"))
    return rows.select("define", F.transform("x", lambda r: r["node"]).alias("defined_by"))


def allowed_defines(units: DataFrame) -> DataFrame:
    """``units(unit, define)`` -> ``(unit, defines)``: the defines that a node may take from each unit."""
    return units.groupBy("unit").agg(F.array_sort(F.collect_set("define")).alias("defines"))


def resolved(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """``items(ord, node, title_key)``, ``nodes(node, ord, title_key)`` -> items with ``target``: their own node, or the last one of their title; null if there is neither."""
    titles = nodes.groupBy("title_key").agg(F.max_by("node", "ord").alias("by_title"))
    return items.join(titles, "title_key", "left").withColumn("target", F.coalesce(F.nullif(F.col("node"), F.lit("")), "by_title")).drop("by_title")


def attached(nodes: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``column`` of the last of ``items(ord, node, column)`` for their node; an empty list without one."""
    last = items.groupBy("node").agg(F.max_by(column, "ord").alias(column))
    return nodes.join(last, "node", "left").withColumn(column, F.coalesce(column, F.array().cast(items.schema[column].dataType)))


def replaced(nodes: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` without those in ``gone(node)``, and the new ones."""
    return nodes.join(gone.select("node").distinct(), "node", "left_anti").unionByName(new)


def first_conflict(conflicts: DataFrame) -> DataFrame:
    """``conflicts(orders, nodes, kind, define)`` -> the one that comes first, in that order of columns."""
    key = F.struct("orders", "nodes", "kind", "define")
    return conflicts.agg(F.min(key).alias("c")).where("c is not null").select("c.*")


def unassigned_share(units: DataFrame, unassigned: DataFrame, *, most: float = 0.10) -> DataFrame:
    """One row: how many units there are, how many no node claims, their share, and whether it is above ``most``."""
    n, out = units.agg(F.count_distinct("unit").alias("units")), unassigned.agg(F.count_distinct("unit").alias("unassigned"))
    rows = n.join(out)  # one row each
    share = F.when(F.col("units") > 0, F.col("unassigned") / F.col("units")).otherwise(0.0)
    return rows.select("units", "unassigned", share.alias("share"), (share > most).alias("warning"))


def root_review(prerequisites: DataFrame) -> DataFrame:
    """``prerequisites(node, required)`` -> one row: nodes, roots (nothing required), and whether there are suspiciously many.

    Suspicious: more than one node and all are roots, or five nodes or more of which 0.80 are.
    """
    rows = prerequisites.agg(F.count("*").alias("nodes"), F.count_if(F.size("required") == 0).alias("roots"))
    many = (F.col("nodes") >= 5) & (F.col("roots") / F.col("nodes") >= 0.80)
    return rows.withColumn("suspicious", (F.col("nodes") > 1) & ((F.col("roots") == F.col("nodes")) | many))


#: What a node may define and require at most.
MOST_DEFINES, MOST_REQUIRED = 8, 24


def prerequisite_problems(items: DataFrame, nodes: DataFrame, defines: DataFrame) -> DataFrame:
    """``items(ord, node, decision, required, reason)`` -> ``(ord, node, problem)``: the first rule that each item breaks, null if none.

    In this order: the node is known, it has no item before, the decision agrees with what is required and is one of the two, there are
    MOST_REQUIRED keys at most, nothing is required without a reason, all keys are known, and none is defined by the node alone.
    ``nodes(node)``, ``defines(key, node)``; ``required`` holds keys.
    """
    known = nodes.select("node", F.lit(True).alias("known")).distinct()
    first = items.groupBy("node").agg(F.min("ord").alias("first"))
    rows = items.join(known, "node", "left").join(first, "node", "left")
    sources = defines.groupBy("key").agg(F.count_distinct("node").alias("n_sources"), F.min("node").alias("source"))
    keys = items.select("ord", "node", F.explode("required").alias("key")).join(sources, "key", "left")
    marks = keys.groupBy("ord", "node").agg(F.bool_or(F.col("n_sources").isNull()).alias("strange"), F.bool_or((F.col("n_sources") == 1) & (F.col("source") == F.col("node"))).alias("own"))
    rows = rows.join(marks, ["ord", "node"], "left")
    n = F.size("required")
    problem = (
        F.when(F.col("known").isNull(), "unknown_node").when(F.col("ord") > F.col("first"), "duplicate_node")
        .when((F.col("decision") == "selected") & (n == 0), "selected_without_defines").when((F.col("decision") == "none") & (n > 0), "none_with_defines")
        .when(~F.coalesce("decision", F.lit("")).isin("selected", "none"), "no_decision").when(n > MOST_REQUIRED, "too_many")
        .when((n == 0) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no_reason").when(F.col("strange"), "unknown_define").when(F.col("own"), "own_define")
    )
    return rows.select("ord", "node", problem.alias("problem"))


def uncovered_nodes(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an item."""
    return nodes.select("node").join(items.select("node"), "node", "left_anti")


def replacement_problems(nodes: DataFrame, candidates: DataFrame, unit_defines: DataFrame | None = None) -> DataFrame:
    """``nodes(ord, title, members, defines)`` -> ``(ord, problem)``: the first rule that each proposed node breaks, null if none.

    In this order: a title, one to MOST_DEFINES defines, members, members among ``candidates(unit)``, none that an earlier node has, and
    (with ``unit_defines(unit, define)``) defines that its members have.
    """
    pairs = nodes.select("ord", F.explode("members").alias("unit"))
    first = pairs.groupBy("unit").agg(F.min("ord").alias("first"))
    marks = pairs.join(candidates.select("unit", F.lit(True).alias("known")).distinct(), "unit", "left").join(first, "unit")
    marks = marks.groupBy("ord").agg(F.bool_or(F.col("known").isNull()).alias("outside"), F.bool_or(F.col("first") < F.col("ord")).alias("repeated"))
    rows = nodes.join(marks, "ord", "left")
    if unit_defines is not None:
        have = pairs.join(unit_defines, "unit").select("ord", "define").distinct()
        asked = nodes.select("ord", F.explode("defines").alias("define"))
        rows = rows.join(asked.join(have, ["ord", "define"], "left_anti").select("ord", F.lit(True).alias("invented")).distinct(), "ord", "left")
    else:
        rows = rows.withColumn("invented", F.lit(None).cast("boolean"))
    problem = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "no_title").when(F.coalesce(F.size("defines"), F.lit(0)) <= 0, "no_defines")
        .when(F.size("defines") > MOST_DEFINES, "too_many_defines").when(F.coalesce(F.size("members"), F.lit(0)) <= 0, "no_members")
        .when(F.col("outside"), "outside").when(F.col("repeated"), "repeated").when(F.col("invented"), "invented_define")
    )
    return rows.select("ord", problem.alias("problem"))


def omitted_members(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate units that no proposed node has."""
    return candidates.select("unit").join(nodes.select(F.explode("members").alias("unit")), "unit", "left_anti")


def cycle_repair_problems(before: DataFrame, after: DataFrame, cycle: DataFrame, defines: DataFrame) -> DataFrame:
    """``before``, ``after`` ``(node, required, external, decision)`` -> ``(node, problem)``: the first rule that a repair of a cycle breaks, null if none.

    External prerequisites stay; off the cycle's ends (``cycle(src, dst)``) required keys and decisions stay; on them no key is added, and only keys
    that a source of the cycle's edges into the node defines (``defines(key, node)``) go.
    """
    a = before.select("node", F.array_distinct("required").alias("r1"), F.col("external").alias("e1"), F.col("decision").alias("d1"))
    b = after.select("node", F.array_distinct("required").alias("r2"), F.col("external").alias("e2"), F.col("decision").alias("d2"))
    ends = cycle.select(F.col("dst").alias("node"), F.lit(True).alias("on_cycle")).distinct()
    free = cycle.join(defines.select("key", F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.collect_set("key").alias("free"))
    rows = a.join(b, "node").join(ends, "node", "left").join(free, "node", "left")
    added, gone = F.array_except("r2", "r1"), F.array_except("r1", "r2")
    kept = F.array_except(gone, F.coalesce("free", F.array().cast("array<string>")))
    off = F.col("on_cycle").isNull()
    problem = (
        F.when(~F.col("e1").eqNullSafe(F.col("e2")), "external_changed").when(off & ((F.size(added) > 0) | (F.size(gone) > 0)), "changed_off_cycle")
        .when(off & ~F.col("d1").eqNullSafe(F.col("d2")), "decision_changed").when(F.size(added) > 0, "added").when(F.size(kept) > 0, "removed_off_cycle")
    )
    return rows.select("node", problem.alias("problem"))


def merged_without_defines(nodes: DataFrame) -> DataFrame:
    """``nodes(collection, ord, node, members, defines)`` -> nodes where each one without defines has gone into its ``nearest_with_defines``.

    A node that takes others in has all their members, a new id by them, and the least of their places. A node without any to go into stays.
    Nodes are of one collection each.
    """
    near = nearest_with_defines(nodes.withColumn("n_defines", F.size("defines")))
    own = F.col("node") == F.col("target")
    rows = near.groupBy("collection", "target").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.min("ord").alias("ord"), F.max(F.when(own, F.col("defines"))).alias("defines"), F.count("*").alias("n")
    )
    node = F.when(F.col("n") > 1, prefixed_id("kn", F.array_join("members", "|"))).otherwise(F.col("target"))
    return rows.select("collection", "ord", node.alias("node"), "members", "defines")


def cluster_payload(members: DataFrame, units: DataFrame) -> DataFrame:
    """``members(cluster, unit)``, ``units(unit, ord, title, defines)`` -> ``(cluster, single, units)``: each cluster's units in order as one row to work on."""
    rows = members.join(units, "unit").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("ord", "unit", "title", "defines"))).alias("units"))
    return rows.select("cluster", (F.size("units") == 1).alias("single"), "units")
