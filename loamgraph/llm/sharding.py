"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import stored


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, its place, its weight, and the weight that its place may come to have."""

    number: int
    region: int
    rack: int
    weight: float = 1.0
    capacity: float = 1.0


#: Descents that a key tries at most before all leaves draw at once; with two thirds of the places taken, one key in half a million does.
TRIES = 12


def tree(n_shards: int, *, per_rack: int = 4, racks_per_region: int = 3, places: int | None = None) -> list[Shard]:
    """``n_shards`` equal shards, filled rack by rack and region by region, and empty places (weight 0) up to ``places``.

    ``places`` is by default what the regions in use and one more hold, so a tree may grow by a region before any other place changes.
    """
    per_region = per_rack * racks_per_region
    every = places or (n_shards // per_region + 1) * per_region
    if every < n_shards:
        raise ValueError("more shards than places")
    return [Shard(i, i // per_region, i // per_rack, 1.0 if i < n_shards else 0.0) for i in range(every)]


def _uniform(*parts: str) -> str:
    """A draw in (0, 1) that depends on the parts only: 52 bits of an MD5, so that SQL engines agree on it."""
    return f"((cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as double) + 0.5D) / {float(1 << 52):.1f}D)"


def _draw(key: str, level: str, children: str) -> str:
    """The child of the least exponential draw: each is drawn with a chance proportional to its weight, and only its own weight bears on its draw."""
    u = _uniform(key, f"concat('{level}', c.id)")
    return f"array_min(transform({children}, c -> struct(-ln({u}) / c.weight AS draw, c.id AS id))).id"


def _nodes(of: dict[int, float]) -> str:
    return f"array({', '.join(f'struct({i} AS id, {float(w)!r}D AS weight)' for i, w in sorted(of.items()))})"


def _lookup(pairs: dict, value=str) -> str:
    return f"map({', '.join(f'{k}, {value(v)}' for k, v in pairs.items())})"


def place(key: str, shards: list[Shard]) -> Column:
    """``struct(region, rack, shard)`` of the key in a column.

    A key descends the tree: a region is drawn, then a rack of it, then a shard of that, each with a chance proportional to the capacity
    below it, by draws that depend on the key and the child alone. A shard takes the key with a chance of weight over capacity;
    else the key descends anew with other draws, TRIES times at most, and then all leaves draw at once by weight.

    A change of a shard's weight lets keys into that shard or out of it, and no other key moves: the descents stay as they are, and only
    those that end at this shard come out otherwise. A change of capacities moves keys in the subtrees that hold them, by the draws at each level.
    The expression is written as one text, as it names every place of the tree.
    """
    leaves = sorted(shards, key=lambda s: s.number)
    if not any(s.weight > 0 for s in leaves):
        raise ValueError("no shard with a weight")
    if any(s.weight > s.capacity for s in leaves):
        raise ValueError("a shard's weight is above its capacity")
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    own: dict[int, dict[int, float]] = {}
    for s in leaves:
        regions[s.region] = regions.get(s.region, 0.0) + s.capacity
        in_region = racks.setdefault(s.region, {})
        in_region[s.rack] = in_region.get(s.rack, 0.0) + s.capacity
        own.setdefault(s.rack, {})[s.number] = s.capacity
    rack_of = _lookup({s.number: s.rack for s in leaves})
    region_of = _lookup({s.rack: s.region for s in leaves})
    chance = _lookup({s.number: s.weight / s.capacity for s in leaves}, lambda p: f"{p!r}D")
    name = f"coalesce(cast(`{key}` as string), 'null')"

    def descent(attempt: int) -> str:
        k = f"{name}, '{attempt}'"
        region = _draw(k, "region", _nodes(regions))
        rack = _draw(k, "rack", f"{_lookup(racks, _nodes)}[{region}]")
        shard = _draw(k, "shard", f"{_lookup(own, _nodes)}[{rack}]")
        # The shard is worked out once, as the one item of an array.
        return f"transform(array({shard}), x -> CASE WHEN {_uniform(k, "concat('take', x)")} < {chance}[x] THEN x END)[0]"

    last = _draw(name, "all", _nodes({s.number: s.weight for s in leaves if s.weight > 0}))
    found = f"coalesce({', '.join([*map(descent, range(TRIES)), last])})"
    return F.expr(f"transform(array({found}), x -> struct({region_of}[{rack_of}[x]] AS region, {rack_of}[x] AS rack, x AS shard))[0]")


def assign(docs: DataFrame, shards: list[Shard], *, grown: list[Shard] | None = None, key: str = "doc_id", text: str = "text", buckets: int = 1024, carry: bool = False) -> DataFrame:
    """``docs`` -> ``(doc_id, size, text_crc32, region, rack, shard, slot)``, a row for each row; with ``carry``, after its own columns.

    Law ``key``: the id and the tree decide. ``size`` is the UTF-8 length of the text plus 8 (null
    text: 8), ``text_crc32`` the unsigned CRC-32 of the text (null: of no bytes, 0). ``grown`` adds ``grown_shard``, by that tree. ``slot``
    numbers the rows of a shard from 0 without gaps: a shard is cut into ``buckets`` buckets by a hash of id, size and checksum, so rows
    without id, or with the same one, are spread; bucket offsets are summed over counts, and rows are numbered within buckets, so no task orders
    a whole shard. Rows alike in all three take neighbouring slots in any order. Without ``carry`` what is worked out is stored once; with it that
    would be a copy of the documents, and places are worked out twice, which gives the same. Other columns are not read; a carried one named like a new one gives way to it. No rows give no rows.
    """
    new = {
        "doc_id": F.col(key),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
    }
    if grown is not None:
        new["grown_shard"] = place(key, grown)["shard"]
    given = {"region", "rack", "shard", "slot"}
    own = [F.col(c) for c in docs.columns if c not in given | set(new)] if carry else []
    rows = docs.select(*own, *(c.alias(n) for n, c in new.items()), place(key, shards).alias("__at"))
    rows = rows.select(*(c for c in rows.columns if c != "__at"), "__at.region", "__at.rack", "__at.shard")
    mixed = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    bucket = F.conv(F.substring(F.md5(mixed), 1, 8), 16, 10).cast("long") % buckets
    rows = rows.withColumn("__bucket", bucket.cast("int"))
    return slots(rows if carry else stored(rows, "placed"))


def slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot`` to ``rows(doc_id, size, text_crc32, shard, __bucket, ...)`` and drops ``__bucket``."""
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__k", F.row_number().over(within) - 1)
    # The offsets have one row for each shard and bucket at most: a size that the parameters bound.
    return numbered.join(F.broadcast(offsets), ["shard", "__bucket"]).withColumn("slot", (F.col("__offset") + F.col("__k")).cast("long")).drop("__offset", "__k", "__bucket")


def shard_documents(docs: DataFrame, *, n_shards: int = 24, buckets: int = 1024) -> DataFrame:
    """``assign`` over ``n_shards`` equal shards, plus ``grown_shard``: the shard if there were one more."""
    places = len(tree(n_shards))
    return assign(docs, tree(n_shards), grown=tree(n_shards + 1, places=places), buckets=buckets)


#: ``shard_documents(documents)`` in DuckDB's SQL; the CRC-32 goes byte by byte over a table that its polynomial gives.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
docs AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes, coalesce(doc_id::VARCHAR, 'null') AS name FROM documents),
base AS (
  SELECT doc_id, name, n + 8 AS size,
         xor(list_reduce(list_transform(bytes, lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM docs, crc_table),
tries AS (SELECT DISTINCT name, unnest(range(12)) AS attempt FROM docs),
regions AS (
  SELECT name, attempt, arg_min(id, -ln((('0x' || substr(md5(name || ':' || attempt || ':region' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS region
  FROM tries, range(3) r(id) GROUP BY ALL),
racks AS (
  SELECT name, attempt, region, arg_min(id, -ln((('0x' || substr(md5(name || ':' || attempt || ':rack' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS rack
  FROM regions, range(9) r(id) WHERE id // 3 = region GROUP BY ALL),
leaves AS (
  SELECT name, attempt, arg_min(id, -ln((('0x' || substr(md5(name || ':' || attempt || ':shard' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS shard
  FROM racks, range(36) r(id) WHERE id // 4 = rack GROUP BY ALL),
tree AS (SELECT unnest([24, 25]) AS n),
fallback AS (
  SELECT name, n, arg_min(id, -ln((('0x' || substr(md5(name || ':all' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS shard
  FROM (SELECT DISTINCT name FROM docs), tree, range(25) r(id) WHERE id < n GROUP BY ALL),
taken AS (SELECT name, n, arg_min(shard, attempt) AS shard FROM leaves, tree WHERE shard < n GROUP BY ALL),
placed AS (SELECT f.name, f.n, coalesce(t.shard, f.shard) AS shard FROM fallback f LEFT JOIN taken t USING (name, n)),
rows AS (
  SELECT b.*, a.shard, g.shard AS grown_shard,
         ('0x' || substr(md5(b.name || ':' || size || ':' || text_crc32), 1, 8))::BIGINT % 1024 AS bucket
  FROM base b JOIN placed a ON a.name = b.name AND a.n = 24 JOIN placed g ON g.name = b.name AND g.n = 25)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard, (shard // 12)::INTEGER AS region, (shard // 4)::INTEGER AS rack
FROM rows
"""
