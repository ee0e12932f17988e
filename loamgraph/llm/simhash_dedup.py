"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import stored
from loamgraph.operators.components import connected_components

SEED = 42
#: Members of a block bucket that one task compares with one another.
CHUNK = 1024


def simhash(text: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text: bit k is set if over half of the shingle hashes have it.

    ASCII letters are lower-cased; a text of fewer than ``width`` words is one shingle; no word gives 0.
    """
    w = text.lower().split()
    n = len(w)
    if not n:
        return 0
    joined = b" ".join(w)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, w), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:z], SEED) for a, z in zip(begin, end)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # long texts in slices, so that the unpacked bits stay small
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text, width: int = 4):
    """The fingerprint column (signed long with the same 64 bits) of a text column; null counts as empty."""

    def of(texts: pa.Array) -> pa.Array:
        fp = np.array([simhash(b, width) if b else 0 for b in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        return pa.array(fp.view(np.int64))

    return F.arrow_udf(of, "long")(text)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the ways to keep ``blocks - radius`` of the blocks that 64 bits are cut into.

    ``radius`` differing bits touch at most ``radius`` blocks, so a close pair agrees on one of the masks at least.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(keep) for keep in combinations(cut, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tree(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of ``x`` at ``radius`` or less that connect all that such pairs connect: one fewer than members of each part."""
    left = np.arange(len(x))
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(x[left] ^ x[at]) <= radius
            if near.any():
                hit = left[near]
                out += [(at, j) for j in hit]
                queue += hit.tolist()
                left = left[~near]
    return out


def _links(radius: int):
    """Batches of (g binary-comparable group columns..., fp), sorted by group -> batches of linked pairs (u, v)."""

    def near(groups: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        size = np.diff(np.r_[start, len(groups)])
        u, v = [], []
        small = np.repeat(size <= 24, size)
        for lag in range(1, min(24, int(size.max()))):
            i = np.flatnonzero((groups[lag:] == groups[:-lag]) & small[lag:])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= radius]
            u.append(fp[i]), v.append(fp[i + lag])
        for k in np.flatnonzero(size > 24):
            x = np.unique(fp[start[k] : start[k] + size[k]])
            if pairs := _tree(x, radius):
                i, j = np.array(pairs).T
                u.append(x[i]), v.append(x[j])
        empty = np.zeros(0, np.uint64)
        return np.concatenate([empty, *u]), np.concatenate([empty, *v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            g = np.concatenate([rest_g, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0  # the last group may go on
            rest_g, rest_f = g[whole:], f[whole:]
            if whole:
                u, v = near(g[:whole], f[:whole])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        if len(rest_g):
            u, v = near(rest_g, rest_f)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def near_pairs(fps: DataFrame, *, radius: int = 4, blocks: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``fps(fp long)`` -> ``(u, v)``: linked pairs that connect all fingerprints within ``radius``.

    Every fingerprint goes to one bucket for each mask of kept blocks. Buckets of one member end
    there. A bucket of more than ``chunk`` members is dealt over the pairs of its chunks, so a
    task never holds more than two chunks, however many members a bucket has. In a task the exact
    Hamming distances are taken, and a spanning forest of the close pairs leaves it: links grow
    with the members, not with the square of a bucket.
    """
    masks = block_masks(radius, blocks)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("b")).select("fp", "b.*")
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A merge join: both sides are sized by the fingerprints before their copies for the masks, and would be broadcast by that.
    members = keyed.join(shared.hint("merge"), ["mask", "key"]).withColumn("chunks", F.ceil(F.col("n") / F.lit(chunk)).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    # Equal keys get equal group numbers; two groups that share a number by chance are only compared for nothing.
    group = F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = members.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(_links(radius), "u long, v long").distinct()


#: Parts among which the fingerprints of one component are dealt when they get their component's id.
SALTS = 32


def _components(own: DataFrame, *, radius: int, blocks: int) -> DataFrame:
    """``own(doc_id, fp, ...)`` -> ``(fp, component, component_id)``, a row for each different fingerprint.

    ``component`` is the least fingerprint that links lead to, ``component_id`` the least doc_id of its rows. Fingerprints without a link
    are their own component; of the others, a component's one row is copied for each of SALTS parts, as a component may be large.
    """
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_pairs(distinct.select("fp"), radius=radius, blocks=blocks)
    comp = connected_components(links).withColumnRenamed("node", "fp")
    alone = distinct.join(comp.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"))
    linked = stored(distinct.join(comp, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "linked-fingerprints")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A merge join: adaptive execution would broadcast this table by its size before the copies.
    return alone.unionByName(linked.join(least.hint("merge"), ["component", "salt"]).select("fp", "component", "component_id"))


def simhash_components(docs: DataFrame, *, width: int = 4, radius: int = 4, blocks: int = 7) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp long, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of ``radius`` bits or less; equal
    fingerprints are linked. Only the distinct fingerprints are compared, so thousands of exact copies
    cost one. Null and empty texts have fingerprint 0 and are linked with one another. A row without
    doc_id takes part, but names no component (a component of such rows alone has a null id). Repeated
    rows are returned as often as they come; other columns are not looked at. No rows give no rows.
    """
    own = stored(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    named = _components(own, radius=radius, blocks=blocks)
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, *, width: int = 4, radius: int = 4, blocks: int = 7) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id, with all columns as they are.

    Components are those of ``simhash_components``; what a row says is judged by its own text, never by that of another row with
    its doc_id. Of rows of one component with equal doc_ids the first numbered stays; rows without doc_id come last, and one of them stays
    if a component has no others. Rows are numbered and stored with their fingerprints first, so numbers hold for all that follows.
    """
    fp, rid = "__fp", "__rid"
    held = stored(docs.select("*", fingerprint(F.col("text"), width).alias(fp), F.monotonically_increasing_id().alias(rid)), "fingerprinted")
    own = held.select("doc_id", F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    named = _components(own.select("doc_id", "fp"), radius=radius, blocks=blocks).select("fp", "component")
    best = F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    # Copies with one fingerprint meet before components do, and only one row of each goes on.
    first = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("at")).select("fp", "at.*")
    stay = first.join(named, "fp").groupBy("component").agg(best.alias(rid)).select(rid)
    return held.join(stay, rid, "left_semi").select(docs.columns)
