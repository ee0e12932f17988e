"""Vector search, similarity joins, concept joins and candidate clusters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import vectors as V
from loamgraph.operators.components import connected_components
from loamgraph.operators.ordering import numbered_within
from loamgraph.sources.stages import stored


def metadata_filter(df: DataFrame, filters: dict | None, *, allowed: set[str], include_drafts: bool = True) -> DataFrame:
    """Equality for a scalar, membership for a list; unknown keys and empty lists ask for nothing.

    Without ``include_drafts`` only rows whose ``is_draft`` is false are left; null isn't false.
    """
    for key, want in (filters or {}).items():
        if key not in allowed or key not in df.columns:
            continue
        if isinstance(want, (list, tuple, set)):
            if some := [x for x in want if x is not None]:
                df = df.where(F.col(key).isin(some))
        elif want is not None:
            df = df.where(F.col(key) == F.lit(want))
    if not include_drafts:
        df = df.where(~F.col("is_draft")) if "is_draft" in df.columns else df.where(F.lit(False))
    return df


def topk(df: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a query vector by cosine, ties by key; the sort keeps k rows in each task."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("score", V.cosine(V.doubles(F.col(vector)), wanted))
    return scored.orderBy(F.desc("score"), key).limit(k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, from the flat buffer."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


#: Bytes of vectors that a side of a block has, scores that are compared at once, and decimals of scores that count for their order: equal vectors must tie.
BLOCK_BYTES, SCORES, DECIMALS = 16 << 20, 1 << 22, 12


def _rows_of_block(dims: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, dims)))


def _best(scores: np.ndarray, others: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the ``k`` highest scores of each row from ``least`` on, ties by ``others``."""
    if k < scores.shape[1]:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k:].min(axis=1, keepdims=True) - 2 * 10.0**-DECIMALS)
    rows, cols = np.nonzero((scores >= least) & (scores > -np.inf))
    found = np.round(scores[rows, cols], DECIMALS)
    order = np.lexsort((others[cols], -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    keep = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) < k
    return rows[keep], cols[keep], found[keep]


def _block_top(threshold: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            a, b = (_matrix(t["v"]) for t in (left, right))
            ids, others, at = left["id"].to_numpy(), right["id"].to_numpy(), left["b"].to_numpy()
            meets = right["bs"].combine_chunks()
            visits, row = meets.flatten().to_numpy(zero_copy_only=False), meets.value_parent_indices().to_numpy(zero_copy_only=False)
            for p in np.unique(at):
                mine, seen = np.flatnonzero(at == p), row[visits == p]
                own, names, step = b if len(seen) == len(b) else b[seen], others[seen], max(1, SCORES // max(1, len(seen)))
                for part in np.split(mine, range(step, len(mine), step)) if len(seen) else []:
                    scores = a[part] @ own.T
                    scores[ids[part][:, None] == names[None, :]] = -np.inf
                    rows, cols = np.nonzero(scores >= threshold)
                    if len(rows) > 64 * k * len(part):
                        rows, cols, found = _best(scores, names, k, threshold)
                    else:  # few: no need to look for the k-th of each row
                        found = scores[rows, cols]
                    out.append((ids[part][rows], names[cols], np.round(found, DECIMALS)))
        x, y, z = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((y, -z, x))
        x, y, z = x[order], y[order], z[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
        keep = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) < k
        return pa.table({"id": x[keep], "other": y[keep], "score": z[keep]})

    return run


#: Angles are compared with this much to spare, for rounding.
SPARE = 1e-6


@dataclass(frozen=True)
class Pivots:
    """``members(id, v, cell, b)``: unit vectors, the pivot nearest to each and its cell; ``visitors(id, v, cell, bs)``: each vector once in every cell with pivots ``bs`` where it may have a partner.

    ``block_rows``: how many rows of these vectors a block should have.
    """

    members: DataFrame
    visitors: DataFrame
    block_rows: int


def pivots(vectors: DataFrame, *, threshold: float, most: int = 512) -> Pivots | None:
    """An index on the unit sphere: ``vectors(id long, v array<double>)`` around about as many pivots as the root of their number (``most`` at most); None without vectors.

    A vector belongs to its nearest pivot, and a pivot reaches as far as its farthest member. Whoever is within the threshold's angle of a member is no farther from
    the pivot than that reach and the angle: by the triangle inequality on angles, other vectors need not meet that pivot's members. Pivots are
    vectors taken by a hash of their ids; they and their reaches are what is broadcast, bounded by ``most``. Pivots near one another share a cell of about one block's members, so where
    angles prune little, a vector is sent to each cell and not to each pivot. Rows with a zero or missing vector are left out.
    """
    rows = stored(vectors.select("id", V.doubles(F.col("v")).alias("v")).where(V.norm(F.col("v")) > 0).select("id", V.normalized(F.col("v")).alias("v")), "unit-vectors")
    n = rows.count()
    if not n:
        return None
    p = min(most, max(1, round(n**0.5)))
    centres = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(p).select("v").collect()])
    block_rows = _rows_of_block(centres.shape[1])
    cells = (centres @ centres[: -(-n // block_rows)].T).argmax(axis=1).astype(np.int32)

    def nearest(batches):
        for b in batches:
            near = _matrix(b.column(1)) @ centres.T
            at = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells[at]), pa.array(at.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "b", "angle"])

    members = stored(rows.mapInArrow(nearest, "id long, v array<double>, cell int, b int, angle double"), "members")
    reach = np.full(p, -np.inf)
    for r in members.groupBy("b").agg(F.max("angle").alias("far")).collect():
        reach[r["b"]] = r["far"] + np.arccos(np.clip(threshold, -1, 1)) + SPARE

    def visit(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                row, at = np.nonzero(np.arccos(np.clip(_matrix(part.column(1)) @ centres.T, -1, 1)) <= reach)
                order = np.lexsort((at, cells[at], row))
                row, at = row[order], at[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cells[at][1:] != cells[at][:-1])]) if len(row) else np.zeros(0, int)
                bs = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row[first])).columns, pa.array(cells[at[first]]), bs], ["id", "v", "cell", "bs"])

    return Pivots(members.drop("angle"), rows.mapInArrow(visit, "id long, v array<double>, cell int, bs array<int>"), block_rows)


def comparisons(index: Pivots) -> DataFrame:
    """One row for each pivot: ``(b, members, visitors)``; their products are the pairs that a join compares."""
    left = index.members.groupBy("b").agg(F.count("*").alias("members"))
    return left.join(index.visitors.select(F.explode("bs").alias("b")).groupBy("b").agg(F.count("*").alias("visitors")), "b")


def similarity_join(vectors: DataFrame, *, threshold: float = 0.8, top_k: int = 5, block_rows: int | None = None) -> DataFrame:
    """``vectors(id long, v array<double>)`` -> ``(id, other, score)``: for each id its ``top_k`` others at ``threshold`` or more.

    Exact: members of a pivot meet all vectors that may be near one of them (``pivots``), and others not. Both sides of a cell of pivots are dealt into blocks of
    ``block_rows`` (as many as ``BLOCK_BYTES`` hold), and each pair of blocks is a task's matrix products, with two blocks in memory at
    a time and with at most ``top_k`` candidates of a row leaving it. The best of all blocks are ranked at the end
    (score descending, then the other id). Rows with a zero or missing vector match nothing; no rows give no rows.
    """
    index = pivots(vectors, threshold=threshold)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "id long, other long, score double, rank int")
    block_rows = block_rows or index.block_rows
    sizes = index.members.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("m")).join(index.visitors.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("n")), "cell")
    sizes = stored(sizes, "cell-sizes")  # a row for each cell
    own = F.pmod(F.xxhash64("id"), F.col("m")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")
    left = index.members.join(sizes, "cell").select("id", "v", "b", "cell", *own)
    right = index.visitors.join(sizes, "cell").select("id", "v", "bs", "cell", F.pmod(F.xxhash64("id"), F.col("n")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(_block_top(threshold, top_k), "id long, other long, score double")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_k)


def search(questions: DataFrame, index: DataFrame, *, k: int = 5, block: int = 1024) -> DataFrame:
    """``questions(question long, v)``, ``index(id long, v)`` -> ``(question, id, score, rank)``: the ``k`` nearest rows of the index for each question, by cosine, ties by id.

    Both sides are dealt into blocks of ``BLOCK_BYTES``, and each pair of blocks is a task, which takes ``block`` questions at a time. What it hands on are the best
    ``k`` of each of its questions; those of all tasks are ranked at the end. One job does it, however many questions there are. Filters are put on the index before. Zero or missing vectors
    find nothing and are never found. No questions or an empty index give no rows.
    """
    unit = lambda df, key: df.select(F.col(key).cast("long").alias(key), V.doubles(F.col("v")).alias("v")).where(V.norm(F.col("v")) > 0).select(key, V.normalized(F.col("v")).alias("v"))
    asked, rows, schema = unit(questions, "question"), unit(index, "id"), "question long, id long, score double"
    size = [df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (asked, rows)]
    m, n = (-(-count // _rows_of_block(dims or 1)) for count, dims in size)
    if not m or not n:
        return index.sparkSession.createDataFrame([], f"{schema}, rank int")
    dealt = lambda key, own, to, over, upto: (F.pmod(F.xxhash64(key), F.lit(own)).alias(to), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto - 1).cast("long"))).alias(over))
    left, right = asked.select("*", *dealt("question", m, "i", "j", n)), rows.select("*", *dealt("id", n, "j", "i", m))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_nearest(k, block), schema)
    best = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nearest(k: int, block: int):
    """Blocks (question, v) and (id, v) -> the k best of each question, ``block`` questions at a time (fewer where a block of the index is long)."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            a, b, names, ids = _matrix(asked["v"]), _matrix(rows["v"]), asked["question"].to_numpy(), rows["id"].to_numpy()
            step = max(1, min(block, SCORES // len(ids)))
            for at in range(0, len(a), step):
                q, c, score = _best(a[at : at + step] @ b.T, ids, k)
                out.append((names[at + q], ids[c], score))
        return pa.table(dict(zip(("question", "id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def shared_key_pairs(units: DataFrame) -> DataFrame:
    """``units(id, ord, key)`` -> ``(a, b, key)``: units with an equal key; each links to the first of its key, so pairs don't multiply."""
    first = units.where("key <> ''").groupBy("key").agg(F.min_by("id", F.struct("ord", "id")).alias("a"))
    return units.join(first, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), "key").distinct()


def edge_reasons(edges: DataFrame) -> DataFrame:
    """``edges(a, b, reason)`` of any direction -> one row for each unordered pair, with its sorted reasons."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)``, ``edges(a, b)`` -> ``(id, component)``: the smallest id reachable; nodes without edges are alone."""
    found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return nodes.join(found, nodes.id == found.node, "left").select("id", F.coalesce("component", "id").alias("component"))


def slices(members: DataFrame, *, max_size: int = 8) -> DataFrame:
    """``members(id, component)`` in order of id, cut into slices of ``max_size``; a component may be large, so it isn't numbered in one task."""
    rows = numbered_within(members, "component", "id")
    return rows.withColumn("slice", F.floor((F.col("rank") - 1) / max_size).cast("int")).drop("rank")


def candidate_clusters(vectors: DataFrame, defines: DataFrame | None = None, *, threshold: float = 0.8, top_k: int = 5, max_size: int = 8) -> DataFrame:
    """``vectors(id, v, collection)``, ``defines(id, key, define)`` -> one row for each cluster of similar units.

    Units are linked by similarity (``top_k`` others at ``threshold``) and by keys that they share; linked units in order are cut into clusters of
    ``max_size``. A row has the members, their collections and whether these are several, the number of similarity edges inside, the spellings of
    keys that members share, and the reasons ('embedding', 'shared_define') for which they are together. Units of one key are linked to
    its first unit, which connects what all pairs would; what a cluster shares is counted among its members.
    """
    edges = similarity_join(vectors.select("id", "v"), threshold=threshold, top_k=top_k)
    pairs = stored(edge_reasons(edges.select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit("embedding").alias("reason"))).select("a", "b"), "similar")
    if defines is None:
        defines = vectors.select("id", F.lit("").alias("key"), F.lit("").alias("define")).where("false")
    defines = defines.where("key <> ''")
    links = pairs.unionByName(shared_key_pairs(defines.select("id", F.col("id").alias("ord"), "key")).select("a", "b"))
    members = stored(slices(components(vectors.select("id"), links), max_size=max_size), "clusters")
    place = ["component", "slice"]
    inside = pairs.join(members.withColumnRenamed("id", "a"), "a").join(members.select(F.col("id").alias("b"), F.col("component").alias("c2"), F.col("slice").alias("s2")), "b").where("component = c2 and slice = s2")
    counts = inside.groupBy(*place).agg(F.count("*").alias("n_edges"))
    shared = members.join(defines, "id").groupBy(*place, "key").agg(F.count_distinct("id").alias("n"), F.collect_set("define").alias("said")).where("n > 1")
    shared = shared.groupBy(*place).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("said")))).alias("shared"))
    rows = members.join(vectors.select("id", "collection"), "id").groupBy(*place).agg(F.array_sort(F.collect_list("id")).alias("members"), F.array_sort(F.collect_set("collection")).alias("collections"))
    rows = rows.join(counts, place, "left").join(shared, place, "left")
    none = F.array().cast("array<string>")
    reasons = F.concat(F.when(F.col("n_edges") > 0, F.array(F.lit("embedding"))).otherwise(none), F.when(F.size("shared") > 0, F.array(F.lit("shared_define"))).otherwise(none))
    return rows.select(*place, "members", "collections", (F.size("collections") > 1).alias("cross_collection"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("shared", none).alias("shared"), reasons.alias("reasons"))


def mean_vectors(chunks: DataFrame) -> DataFrame:
    """``chunks(key, v)`` -> ``(key, vector, n)``: each vector normalised, their mean over the shortest length, normalised again.

    Sums are taken dimension by dimension before rows meet, so a key of any size is one small row for each task.
    """
    rows = chunks.select("key", V.normalized(V.doubles(F.col("v"))).alias("v"))
    sizes = rows.groupBy("key").agg(F.min(F.size("v")).alias("dims"), F.count("*").alias("n"))
    sums = rows.select("key", F.posexplode("v").alias("dim", "x")).groupBy("key", "dim").agg(F.sum("x").alias("s"))
    rows = sums.join(sizes, "key").where("dim < dims").groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias("x")))).alias("xs"))
    return rows.select("key", V.normalized(F.transform("xs", lambda x: x["x"])).alias("vector"), "n")


def with_neighbours(hits: DataFrame, chunks: DataFrame, *, window: int = 1) -> DataFrame:
    """``hits(doc, idx)`` widened by the chunks at ``window`` places or less: ``(doc, idx, text, ids)``; a window of 0 keeps the bare text."""
    if window <= 0:
        return hits.join(chunks, ["doc", "idx"]).select("doc", "idx", "text", F.array().cast("array<int>").alias("ids"))
    near = hits.select("doc", "idx", F.explode(F.sequence(F.col("idx") - window, F.col("idx") + window)).alias("at"))
    found = near.join(chunks.select("doc", F.col("idx").alias("at"), "text"), ["doc", "at"])
    rows = found.groupBy("doc", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return rows.select("doc", "idx", F.array_join(F.transform("parts", lambda p: F.trim(p["text"])), "\n\n").alias("text"), F.transform("parts", lambda p: p["at"]).alias("ids"))


def within_budget(hits: DataFrame, *, group: str, order: list[Column | str], text: str = "text", total: int = 96_000, each: int = 24_000) -> DataFrame:
    """Hits in rank order while their texts, cut to ``each``, fit ``total`` characters; the one that no longer fits is cut to what is left."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.least(F.length(text), F.lit(each))
    rows = hits.withColumn("used", F.coalesce(F.sum(own).over(before), F.lit(0)))
    return rows.where(F.col("used") < total).withColumn("taken", F.least(own, F.lit(total) - F.col("used")))


def bounded_text(text: Column, most: int | Column, *, marker: str | Column = "\n…\n") -> Column:
    """The first three quarters and the last quarter of what fits around a marker; a text that fits stays, and where the marker doesn't fit, the text's start is left."""
    most = F.lit(most) if isinstance(most, int) else most
    marker = F.lit(marker) if isinstance(marker, str) else marker
    room = most - F.length(marker)
    head = F.floor(room * 3 / 4).cast("int")
    cut = F.when(room <= 0, F.substring(text, F.lit(1), most)).otherwise(F.concat(F.substring(text, F.lit(1), head), marker, F.right(text, room - head)))
    return F.when(F.length(text) <= most, text).otherwise(cut)
