"""Toxicity by class-conditional Kneser-Ney models over byte n-grams with shared backoff counts."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import hash_share, stored

ORDER = 5
#: Near 1, so that what only one document says weighs little and leans on the shared counts.
DISCOUNT = 0.95
#: N-grams of which a table is broadcast (8 bytes each, and 8 for their places); where there are more, texts' n-grams are joined with them.
MOST_GRAMS = 1 << 24
#: Bytes of the window whose likelihoods are compared beside the whole text: about a word and a half.
WINDOW = 12
#: Texts are worked through in slices of so many bytes.
SLICE = 1 << 20

_FOLD = bytes.maketrans((string.ascii_uppercase + string.punctuation + "\0").encode(), (string.ascii_lowercase + " " * (len(string.punctuation) + 1)).encode())


def folded(text: bytes | None) -> bytes:
    """A text as the models read it: ASCII letters in lower case, punctuation and white space as single spaces, a space at each end."""
    return b" " + b" ".join((text or b"").translate(_FOLD).split()) + b" "


def gram_keys(data: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, from the ORDER-th on, as one integer of ORDER bytes (the last byte lowest)."""
    n = len(data) - ORDER + 1
    key = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER):
        key = (key << 8) | data[k : k + n]
    return key


def _slices(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Groups of whole folded texts of about SLICE bytes; a longer text is a group of its own."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ORDER - 1 zero bytes, and where each begins among the n-grams."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    starts = np.cumsum([0] + [len(t) + ORDER - 1 for t in texts[:-1]])
    return data, starts


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (1, 2))


def count_grams(train: DataFrame) -> DataFrame:
    """``train(text, toxic)`` -> ``(key, toxic_n, plain_n)``: the documents of each class with each n-gram, over all rows.

    A document counts once for an n-gram, so one that repeats a phrase teaches no more than one that says it.

    Tasks count what they read before anything is shuffled; a task hands its counts on whenever it holds 2**21 n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(t):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in t], ["key", "toxic_n", "plain_n"])

        for b in batches:
            labels = b.column(1).to_pylist()
            for label in (0, 1):
                texts = (folded(t) for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), labels) if y == label)
                for group in _slices(texts):
                    data, starts = _padded(group)
                    keys = gram_keys(data)
                    own = np.repeat(np.arange(len(group)), np.diff([*starts, len(keys)]))
                    once = np.unique((own << (8 * ORDER) | keys)[keys & 255 != 0])
                    keys, n = np.unique(once & ((1 << (8 * ORDER)) - 1), return_counts=True)
                    zero = np.zeros_like(n)
                    held.append((keys, n, zero) if label else (keys, zero, n))
                    if sum(len(h[0]) for h in held) > 1 << 21:
                        held = [_merge(held)]
                        if len(held[0][0]) > 1 << 20:
                            yield out(held.pop())
        if held:
            yield out(_merge(held))

    counted = train.select("text", "toxic").mapInArrow(run, "key long, toxic_n long, plain_n long")
    return counted.groupBy("key").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("plain_n").alias("plain_n"))


def _low(key: Column, n: int) -> Column:
    """The last ``n`` bytes of a key."""
    return key.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def log_ratios(grams: DataFrame, *, discount: float = DISCOUNT) -> DataFrame:
    """``grams(key, toxic_n, plain_n)`` -> ``(key, history, ratio, unseen)``.

    ``ratio`` is log P(last byte | bytes before; toxic) - log P(... ; ordinary), each an absolutely
    discounted estimate from its class's counts that backs off to one distribution shared by both.
    The shared one is Kneser-Ney: orders below are estimated from the number of different
    left neighbours, pooled over the classes, and interpolated down to a uniform byte. ``unseen`` is the
    log-ratio after the same history where neither class has the byte: there the shared part cancels out.
    """
    shared = stored(grams, "grams")
    left = {}
    grown = shared.select("key")
    for m in range(ORDER - 1, 0, -1):  # number of left neighbours of each m-gram, from the different (m+1)-grams
        counted = grown.groupBy(_low(F.col("key"), m).alias("key")).agg(F.count("*").alias("n"))
        left[m] = stored(counted, "left-neighbours")
        grown = left[m].select("key")
    prob = None
    for m in range(1, ORDER):
        own = left[m].withColumn("h", F.shiftright("key", 8))
        rows = own.join(own.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "h")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        weight = F.lit(discount) * F.col("kinds") / F.col("total")
        if prob is None:
            prob = rows.select("key", (p + weight / 256).alias("p"))
        else:
            below = prob.select(F.col("key").alias("low"), F.col("p").alias("q"))
            prob = rows.withColumn("low", _low(F.col("key"), m - 1)).join(below, "low").select("key", (p + weight * F.col("q")).alias("p"))
    prob = stored(prob, "shared-model")
    history = F.shiftright("key", 8)
    rows = shared.withColumn("history", history).withColumn("low", _low(F.col("key"), ORDER - 1))
    by_history = rows.groupBy("history").agg(
        F.sum("toxic_n").alias("toxic_all"), F.sum("plain_n").alias("plain_all"),
        F.sum((F.col("toxic_n") > 0).cast("int")).alias("toxic_kinds"), F.sum((F.col("plain_n") > 0).cast("int")).alias("plain_kinds"),
    )
    rows = rows.join(prob.select(F.col("key").alias("low"), "p"), "low").join(by_history, "history")

    def weight(kind: str) -> Column:
        return F.when(F.col(f"{kind}_all") > 0, F.lit(discount) * F.col(f"{kind}_kinds") / F.col(f"{kind}_all")).otherwise(F.lit(1.0))

    def p(kind: str) -> Column:
        own = F.greatest(F.col(f"{kind}_n") - discount, F.lit(0.0)) / F.greatest(F.col(f"{kind}_all"), F.lit(1))
        return own + weight(kind) * F.col("p")

    return rows.select("key", "history", F.log(p("toxic") / p("plain")).alias("ratio"), F.log(weight("toxic") / weight("plain")).alias("unseen"))


_KEY_BITS = 8 * ORDER


def _spread(key: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of keys that deals them evenly over all values of their bits."""
    mask = np.int64((1 << _KEY_BITS) - 1)
    key = (key * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) & mask
    key ^= key >> np.int64(_KEY_BITS // 2)
    return (key * np.int64(0xC2B2AE3D27D4EB4F - (1 << 64))) & mask


class Ratios:
    """Log-ratios by key, all of them: keys in the order of their spread values, and where the values with the same first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, (2 * len(keys)).bit_length())
        spread = _spread(keys.astype(np.int64))
        order = np.argsort(spread)
        spread = spread[order]
        self.start = np.searchsorted(spread >> (_KEY_BITS - self.bits), np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.rest = (spread & ((1 << (_KEY_BITS - self.bits)) - 1)).astype(np.uint32)
        self.value = values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NaN for those that aren't held."""
        spread = _spread(keys)
        bucket = spread >> (_KEY_BITS - self.bits)
        rest = (spread & ((1 << (_KEY_BITS - self.bits)) - 1)).astype(np.uint32)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), np.nan, np.float32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.rest[here] == rest[open_]
            out[open_[hit]] = self.value[here[hit]]
            at[open_] = here + 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


def _packed(rows: DataFrame) -> Ratios:
    """``rows(key, ratio)`` as a table; the caller has seen to their number."""
    told = rows.select("key", F.col("ratio").cast("float").alias("ratio")).toArrow()
    return Ratios(*(told[c].to_numpy() for c in ("key", "ratio")))


@dataclass(frozen=True)
class Tables:
    """``grams`` and ``histories``: the log-ratios of n-grams, and those of bytes not seen after each history; as tables in memory or, where there are too many, as DataFrames (key, ratio)."""

    grams: Ratios | DataFrame
    histories: Ratios | DataFrame


def pack(ratios: DataFrame, *, most: int = MOST_GRAMS) -> Tables:
    """All log-ratios: no n-gram is left out. Up to ``most`` of them come to the driver, to be broadcast."""
    histories = stored(ratios.groupBy(F.col("history").alias("key")).agg(F.first("unseen").alias("ratio")), "histories")
    grams = ratios.select("key", "ratio")
    if ratios.count() > most:
        return Tables(grams, histories)
    return Tables(_packed(grams), _packed(histories))


def features(text: bytes | None, tables: Tables) -> tuple[float, float]:
    """Mean and window maximum of one text; null counts as empty."""
    return tuple(_features([folded(text)], tables)[0])


def _features(texts: list[bytes], tables: Tables) -> np.ndarray:
    """Of each folded text: the mean log-ratio of its bytes, and the largest sum over WINDOW bytes in a row."""
    data, starts = _padded(texts)
    keys = gram_keys(data)
    r = tables.grams.find(keys)
    gap = np.flatnonzero(np.isnan(r))
    r[gap] = np.nan_to_num(tables.histories.find(keys[gap] >> 8))
    r[keys & 255 == 0] = 0
    return _measured(r, starts, np.array([len(t) for t in texts]))


def _measured(r: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of texts whose log-ratios ``r`` begin at ``starts``: their sum by ``size``, and the largest sum over WINDOW in a row."""
    total = np.concatenate([[0], np.cumsum(r, dtype=np.float64)])
    ends = np.concatenate([starts[1:], [len(r)]])
    first = total[np.maximum(np.arange(1, len(total)) - WINDOW, np.repeat(starts, ends - starts))]
    most = np.maximum.reduceat(total[1:] - first, starts)
    return np.stack([(total[ends] - total[starts]) / size, most], axis=1)


def _joined(docs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``docs`` with ``name``, as ``scored`` gives it, by joins of all n-grams of all texts with the tables: the way for tables too large to be broadcast."""
    held = stored(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                data, _ = _padded([folded(text)])
                keys = gram_keys(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), rid)), pa.array(np.arange(len(keys))), pa.array(keys)], ["__rid", "at", "key"])

    def measure(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["at"].to_numpy())
        # ORDER - 1 zero bytes stand before a text, so it has as many n-grams as bytes.
        both = _measured(rows["ratio"].to_numpy()[order], np.array([0]), np.array([len(order)]))
        return pa.table({"__rid": rows["__rid"][:1], "mean": pa.array(both[:, 0]), "most": pa.array(both[:, 1])})

    at = held.select("__rid", "text").mapInArrow(cut, "__rid long, at long, key long").withColumn("history", F.shiftright("key", 8))
    found = at.join(tables.grams.withColumnRenamed("ratio", "own"), "key", "left").join(tables.histories.select(F.col("key").alias("history"), F.col("ratio").alias("unseen")), "history", "left")
    ratio = F.when(F.col("key").bitwiseAND(F.lit(255)) == 0, 0.0).otherwise(F.coalesce("own", "unseen", F.lit(0.0)))
    both = found.select("__rid", "at", ratio.alias("ratio")).groupBy("__rid").applyInArrow(measure, "__rid long, mean double, most double")
    return held.join(both, "__rid").withColumn(name, F.struct("mean", "most")).select(*docs.columns, name)


def scored(docs: DataFrame, tables: Tables, name: str = "raw") -> DataFrame:
    """``docs(text, ...)`` with ``name``, a ``struct(mean, most)`` of the text by the ratio tables; null texts count as empty."""
    if isinstance(tables.grams, DataFrame):
        return _joined(docs, tables, name)
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def of(texts: pa.Array) -> pa.Array:
        model = held.value
        parts = [_features(group, model) for group in _slices(folded(t) for t in texts.cast(pa.binary()).to_pylist())]
        both = np.concatenate(parts) if parts else np.zeros((0, 2))
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["mean", "most"])

    return docs.withColumn(name, F.arrow_udf(of, "mean double, most double")(F.col("text")))


def _design(mean: Column, most: Column) -> list[Column]:
    return [F.lit(1.0), mean * 20, most / 20]


def calibrate(rows: list[tuple[float, float, int]]) -> list[float]:
    """Weights of a logistic curve over (1, 20 * mean, most / 20), by Newton steps with a little ridge."""
    if len({y for *_, y in rows}) < 2:  # one class only: nothing tells the classes apart
        return [-4.0 if not rows or not rows[0][2] else 4.0, 0.0, 0.0]
    x = np.array([(1.0, a * 20, b / 20) for a, b, _ in rows])
    y = np.array([y for *_, y in rows], float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at: crc32 of the id as text leaves 1 modulo 3 (null ids are held out too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Model:
    """A fitted scorer: the two ratio tables and the calibration weights."""

    def __init__(self, tables: Tables, weights: list[float]):
        self.tables, self.weights = tables, weights

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with a column ``name``: the probability of label 1 (an empty text has what calibration gives a ratio of 0)."""
        return scored(docs, self.tables, name).withColumn(name, self._curve(F.col(name)["mean"], F.col(name)["most"]))

    def _curve(self, mean: Column, most: Column) -> Column:
        z = sum((F.lit(w) * x for w, x in zip(self.weights, _design(mean, most))), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, *, calibration_rows: int = 20_000, most_grams: int = MOST_GRAMS) -> Model:
    """Fits on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``.

    Of the rows that aren't held out, a fifth (by a hash of the id) calibrates and the others are
    all counted. Calibration takes ``calibration_rows`` of its fifth at most, by hash order. Rows without id, text
    or label teach nothing; a doc_id labelled more than once counts once, as toxic if any row says so.
    """
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels grow with the corpus: they are never broadcast, whatever their size here.
    rows = docs.select("doc_id", "text").where("text is not null").join(known.hint("merge"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    tables = pack(stored(log_ratios(count_grams(rows.where(~part))), "ratios"), most=most_grams)
    # Texts are scored where they lie; only numbers meet. The count takes null texts along, as no text is read for it.
    n = docs.select("doc_id").join(known.hint("merge"), "doc_id").where(part).count()
    some = hash_share(rows.where(part), calibration_rows, "calibrate", n=n)
    raw = scored(some, tables).select("__order", "doc_id", "raw.mean", "raw.most", "toxic")
    raw = raw.orderBy("__order", "doc_id").limit(calibration_rows).select("mean", "most", "toxic").collect()
    return Model(tables, calibrate([tuple(r) for r in raw]))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; nothing but the text enters a score.

    Null and empty texts get the score of a log-ratio of 0. Repeated rows get equal scores. Without
    labels of both classes all scores are equal and below the threshold, unless all labels are 1.
    """
    rows = docs.select("doc_id", "text")
    out = fit(docs, labels).score(rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns."""
    name = "__toxicity"
    return fit(docs, labels).score(docs, name).where(F.col(name) < threshold).drop(name)
