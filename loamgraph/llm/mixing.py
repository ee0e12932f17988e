"""Mixing sources by temperature, realised as budgeted block permutations (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import n_words, stored

STEPS = 40


def _hash(*parts: Column | str) -> Column:
    """60 bits of an MD5 of the parts' texts, as a long, so that SQL engines agree on it."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("long")


def _body(text: Column) -> Column:
    """What tells rows of one doc_id, or of none, apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def _repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row once for each of ``times`` passes from 0 on, numbered as ``name``; none for 0. Passes are dealt out in two steps, so that no array is long."""
    piece = F.lit(1 << 15).cast("long")
    rows = rows.withColumn("__times", times.cast("long")).where("__times > 0")
    rows = rows.withColumn("__high", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__times - 1) div 32768"))))
    low = F.sequence(F.lit(0).cast("long"), F.least(piece, F.col("__times") - F.col("__high") * piece) - 1)
    return rows.withColumn("__low", F.explode(low)).withColumn(name, F.col("__low") + F.col("__high") * piece).drop("__times", "__high", "__low")


def token_rows(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, text)`` -> ``(doc_id, body, source, n_tokens)``: words of the whole text, 1 for a text without any, and a hash of it."""
    return docs.select("doc_id", _body(F.col("text")).alias("body"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.greatest(n_words(F.col("text")), F.lit(1)).alias("n_tokens"))


def bisect_exponent(sources: DataFrame, *, repetition: float | None = None, entropy: float | None = None) -> float:
    """The exponent nearest 1 whose weights meet the target; ``sources(source, tokens)``.

    Weights are token shares to the power of the exponent, normalised. ``repetition``: no source is repeated more than so
    often in a mixture that holds every document at least once. Otherwise ``entropy``: that of the weights is at
    least this share of the greatest possible, and each of STEPS halvings is one aggregate over the table of sources, of which
    one row comes back. A target out of reach gives 0 (equal weights), one that the shares meet gives 1.
    """
    if repetition is not None:
        # Of the weights only the greatest and the least bear on how often a source is repeated: one row comes back.
        most, least = sources.agg(F.max("tokens"), F.min("tokens")).first()
        ratio = most / least if least else 1.0
        low, high = 0.0, 1.0  # met from some exponent on
        if ratio <= repetition:
            return 0.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if ratio ** (1 - mid) <= repetition else (mid, high)
        return round(high, 9)
    every = sources.agg(F.sum("tokens")).first()[0] or 1
    shares = sources.select((F.col("tokens") / F.lit(every)).alias("p"))

    def met(a: float) -> bool:
        total, part, n = shares.agg(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")), F.count("*")).first()
        if n < 2:
            return True
        return math.log(total) - a * part / total >= entropy * math.log(n)

    low, high = 0.0, 1.0  # met up to some exponent
    if met(high):
        return 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if met(mid) else (low, mid)
    return round(low, 9)


@dataclass(frozen=True)
class Mixture:
    """``rows(doc_id, source, n_tokens)`` and ``sources(source, tokens, docs, blocks, weight, budget, full, rest)``; both stored."""

    exponent: float
    rows: DataFrame
    sources: DataFrame


def mixture(docs: DataFrame, *, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> Mixture:
    """Weights and token budgets of ``docs(doc_id, source, text)``.

    ``budget`` tokens are dealt out by weight; without one, as many as it takes for every source to be
    read once in full. ``full`` whole passes over a source and ``rest`` tokens of one more make up its budget.
    A null source is the source ''. No rows give empty tables.
    """
    rows = stored(token_rows(docs), "tokens")
    totals = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    a = bisect_exponent(totals, repetition=repetition, entropy=entropy)
    every = totals.agg(F.sum("tokens")).first()[0] or 1
    powers = totals.withColumn("power", F.pow(F.col("tokens") / F.lit(every), F.lit(a)))
    scale, least = powers.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    scale, least = scale or 1.0, least or 0.0
    own = F.lit(least if budget is None else budget / scale) * F.col("power")
    dealt = powers.select(
        "source", "tokens", "docs", F.ceil(F.sqrt("docs")).cast("long").alias("blocks"),
        (F.col("power") / F.lit(scale)).alias("weight"), F.round(own).cast("long").alias("budget"),
    )
    full = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    return Mixture(a, rows, stored(dealt.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "weights"))


def _block(rows: DataFrame) -> Column:
    return F.pmod(_hash("block", F.col("doc_id"), F.col("body")), F.col("blocks"))


def permuted(mix: Mixture) -> DataFrame:
    """The mixture's stream: ``(doc_id, source, pass, block, n_tokens, weight, position, order_key)``.

    Documents fall into blocks of their source by a hash (as many blocks as the root of its documents, so that neither
    blocks nor their number grow large). In each pass blocks are permuted, and documents within blocks; a document's
    ``position`` is the tokens of its source before it, from the sums of whole blocks and a running sum in its own.
    Those that begin within the budget are in. ``order_key`` in [0, 1) places them among all sources, so that any
    stretch of the stream holds the weights. Rows of one doc_id, or of none, fall into blocks by their texts; repeated rows are dealt one by one.
    Budgets are 64-bit, and a source may be read any number of times; each time is a row. No rows give no rows.
    """
    src = mix.sources.select("source", "blocks", "weight", "budget", "tokens")
    rows = mix.rows.join(src, "source").withColumn("block", _block(mix.rows))
    times = F.greatest(F.ceil(F.col("budget") / F.col("tokens")), F.lit(1))
    passes = _repeated(rows, times, "pass")
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("budget").alias("budget"), F.first("tokens").alias("tokens"))
    blocks = _repeated(blocks, times, "pass")
    before = Window.partitionBy("source", "pass").orderBy(_hash("order", F.col("pass"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "pass", "block", (F.col("pass") * F.col("tokens") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"))
    inner = Window.partitionBy("source", "pass", "block").orderBy(_hash("within", F.col("pass"), F.col("doc_id"), F.col("body")), "doc_id", "n_tokens", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = passes.join(offsets, ["source", "pass", "block"]).withColumn("position", F.col("offset") + F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    return placed.where("position < budget").select("doc_id", "source", "pass", "block", "n_tokens", "weight", "position", (F.col("position") / F.col("budget")).alias("order_key"))


def cutoffs(mix: Mixture) -> DataFrame:
    """Where each source's last pass ends: ``(source, full, last_block, last_doc)`` as hashes up to which blocks, and documents of the last block, are in.

    Sources whose budget is a whole number of passes have no row; rows alike in doc_id and text share hashes, so all or none of them are in.
    """
    src = mix.sources.where("rest > 0").select("source", "blocks", "full", "rest")
    rows = mix.rows.join(src, "source").withColumn("block", _block(mix.rows))
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("order", _hash("order", F.col("full"), F.col("source"), F.col("block")))
    before = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("offset") < F.col("rest")) & (F.col("offset") + F.col("n") >= F.col("rest")))
    inside = rows.join(last.select("source", "block", "offset", "order"), ["source", "block"]).withColumn("h", _hash("within", F.col("full"), F.col("doc_id"), F.col("body")))
    inner = Window.partitionBy("source", "block").orderBy("h", "doc_id", "n_tokens", "body").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("begin", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).where("begin < rest")
    return inside.groupBy("source").agg(F.first("order").alias("last_block"), F.max("h").alias("last_doc"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, each as often as its mixture reads it, with all columns, in the order of the mixture's stream.

    What is read is told row by row from each source's budget and where its last pass ends. Copies are dealt into ranges of the stream
    and sorted there: pass after pass, in each the blocks of a source in their permutation and the documents of a block in theirs, and
    sources side by side by the share of their budget that lies before. So each file that is written is a stretch of the stream,
    and the copies of a document are a pass apart. Rows of one doc_id, or of none, are told apart by their texts; those with equal texts, too,
    end together, so a source may get as many tokens more as such a group has. A null source is the source ''. No rows give no rows.
    """
    mix = mixture(docs, **params)
    s, f, b, o, d, e = "__source", "__full", "__blocks", "__last_block", "__last_doc", "__epochs"
    plan = mix.sources.select("source", "full", "blocks", (F.col("budget") / F.col("tokens")).alias("epochs")).join(cutoffs(mix), "source", "left")
    plan = stored(plan.select(F.col("source").alias(s), F.col("full").alias(f), F.col("blocks").alias(b), F.col("last_block").alias(o), F.col("last_doc").alias(d), F.col("epochs").alias(e)), "passes")
    rows = docs.withColumn(s, F.coalesce(F.col("source").cast("string"), F.lit(""))).join(plan, s)
    body = _body(F.col("text"))
    block = F.pmod(_hash("block", F.col("doc_id"), body), F.col(b))
    order = _hash("order", F.col(f), F.col(s), block)
    more = F.when((order < F.col(o)) | ((order == F.col(o)) & (_hash("within", F.col(f), F.col("doc_id"), body) <= F.col(d))), 1).otherwise(0)
    copies = _repeated(rows, F.col(f) + more, "__pass")
    # The hash of a block is its place in its pass: hashes are even, so shares of a pass come out in proportion.
    at = (F.col("__pass") + _hash("order", F.col("__pass"), F.col(s), block) / F.lit(float(1 << 60))) / F.col(e)
    placed = copies.select(*docs.columns, at.alias("__at"), F.col(s), _hash("within", F.col("__pass"), F.col("doc_id"), body).alias("__within"))
    return placed.repartitionByRange("__at", s, "__within").sortWithinPartitions("__at", s, "__within").select(*docs.columns)


#: ``permuted(mixture(documents))`` with the parameters of the registered query, in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, md5(coalesce(text, '')) AS body, coalesce(source, '') AS source,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS n_tokens
  FROM documents),
tot AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM toks GROUP BY source),
span AS (SELECT max(tokens) / min(tokens) AS ratio FROM tot),
halving(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN ratio <= 2.0 THEN 0.0 ELSE 1.0 END::DOUBLE FROM span
  UNION ALL
  SELECT k + 1,
         CASE WHEN pow(ratio, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(ratio, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM halving, span WHERE k < 40),
expo AS (SELECT round(high, 9) AS a FROM halving WHERE k = 40),
pw AS (SELECT source, tokens, docs, pow(tokens / (SELECT sum(tokens) FROM tot), a) AS power FROM tot, expo),
sc AS (SELECT sum(power) AS scale, max(tokens / power) AS least FROM pw),
src AS (SELECT source, tokens, ceil(sqrt(docs))::BIGINT AS blocks, power / scale AS weight,
               round(least * power)::BIGINT AS budget FROM pw, sc),
numbered AS (SELECT t.*, s.tokens, s.weight, s.budget, s.blocks,
                    ('0x' || substr(md5('block:' || coalesce(doc_id::VARCHAR, 'null') || ':' || body), 1, 15))::BIGINT % s.blocks AS block
             FROM toks t JOIN src s USING (source)),
passes AS (SELECT source, unnest(range(greatest(ceil(budget / tokens), 1)::BIGINT)) AS pass FROM src),
blk AS (SELECT source, block, sum(n_tokens) AS n FROM numbered GROUP BY ALL),
off AS (SELECT b.source, p.pass, b.block,
               p.pass * s.tokens + coalesce(sum(b.n) OVER (PARTITION BY b.source, p.pass
                 ORDER BY ('0x' || substr(md5('order:' || p.pass || ':' || b.source || ':' || b.block), 1, 15))::BIGINT, b.block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
        FROM blk b JOIN passes p USING (source) JOIN src s USING (source)),
placed AS (SELECT d.doc_id, d.source, o.pass, o.block, d.n_tokens, d.weight, d.budget,
                  o."offset" + sum(d.n_tokens) OVER (PARTITION BY d.source, o.pass, o.block
                    ORDER BY ('0x' || substr(md5('within:' || o.pass || ':' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.body), 1, 15))::BIGINT, d.doc_id, d.n_tokens, d.body
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.n_tokens AS position
           FROM numbered d JOIN off o ON d.source = o.source AND d.block = o.block)
SELECT doc_id, source, pass::BIGINT AS pass, block::BIGINT AS block, n_tokens, round(weight, 9) AS weight,
       position::BIGINT AS position, round(position / budget, 9) AS order_key
FROM placed WHERE position < budget
"""
