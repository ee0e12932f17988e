"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
BLOCKS, BLOCK_BITS = 8, 8


def folded_words(text: str | None) -> list[str]:
    """The words (runs of letters, digits and underscores) of a text in lower case, so that punctuation and layout don't matter."""
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of all shingles of ``width`` words; fewer words are one shingle.

    A weight is 1 and the logarithm of the letters of a shingle's different words: long and different words say more than
    short or repeated ones. It depends on the shingle alone, so a similarity is the same whatever else a benchmark holds.
    """
    parts = [words[i : i + width] for i in range(len(words) - width + 1)] if len(words) >= width else [words] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(p)) for p in parts], np.uint64)
    return hashes, 1.0 + np.log(np.array([sum(map(len, set(p))) for p in parts], float))


def _window_prints(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Weighted SimHash of the ``span`` shingles from each of ``starts`` on, from running sums of the bits' votes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    votes = np.concatenate([np.zeros((1, 64)), np.cumsum((bits * 2 - 1) * weight[:, None], axis=0)])
    return np.packbits(votes[starts + span] - votes[starts] > 1e-9, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """What tasks need to know of a bounded block of benchmark items; ``find`` searches one text."""

    def __init__(self, items: list[tuple[int, str]], *, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        split = [(i, w) for i, w in ((i, folded_words(t)) for i, t in items) if w]
        prints = [(i, w, *shingles(w)) for i, w in split]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, own in split for w in own}), 1)}
        self.short: dict[tuple[str, ...], list[int]] = {}
        self.by_length: dict[int, dict] = {}
        keys: dict[int, set[int]] = {}
        for i, w, h, weight in prints:
            if len(w) < WIDTH:
                self.short.setdefault(tuple(w), []).append(i)
                continue
            own = self.by_length.setdefault(len(w), {"ids": [], "bags": [], "prints": []})
            own["ids"].append(i)
            own["bags"].append((Counter(h.tolist()), dict(zip(h.tolist(), weight.tolist())), float(weight.sum())))
            own["prints"].append(int(_window_prints(h, weight, np.array([0]), len(h))[0]))
            for key in self._keys(np.array([self.vocabulary[x] for x in w], np.uint64)).tolist():
                keys.setdefault(key, set()).add(len(w))
        self.keys = np.array(sorted(keys), np.uint64)
        self.lengths = [sorted(keys[k]) for k in self.keys.tolist()]
        self.short_sizes = sorted({len(k) for k in self.short})
        near = np.array([bin(x).count("1") for x in range(1 << BLOCK_BITS)])
        for own in self.by_length.values():
            own["prints"] = np.array(own["prints"], np.uint64)
            # Of `radius` differing bits at most radius // BLOCKS fall on some block: its near values lead to every item within the radius.
            cells = own["prints"].view(np.uint8).reshape(-1, BLOCKS)
            own["blocks"] = []
            for b in range(BLOCKS):
                close = near[np.arange(256)[:, None] ^ cells[None, :, b]] <= radius // BLOCKS
                value, item = np.nonzero(close)
                own["blocks"].append((np.searchsorted(value, np.arange(257)), item))

    @staticmethod
    def _keys(ids: np.ndarray) -> np.ndarray:
        n = len(ids) - WIDTH + 1
        key = np.zeros(max(n, 0), np.uint64)
        for k in range(WIDTH):
            key = key * _P + ids[k : k + n]
        return key

    def find(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """The (item, similarity, Hamming distance, first word, words) of the best window of each item that the text holds."""
        words = folded_words(text)
        n = len(words)
        if not n:
            return []
        best: dict[int, tuple] = {}
        for size in self.short_sizes:
            for s in range(n - size + 1):
                for item in self.short.get(tuple(words[s : s + size]), ()):
                    best.setdefault(item, (1.0, 0, s, size))
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, n)
        # A window's similarity is over 0 only if it holds a shingle of an item: only such windows are taken.
        known = ids > 0
        runs = np.flatnonzero(np.logical_and.reduce([known[k : n - WIDTH + 1 + k] for k in range(WIDTH)])) if n >= WIDTH else []
        if len(runs) and len(self.keys):
            keys = np.zeros(len(runs), np.uint64)
            for k in range(WIDTH):
                keys = keys * _P + ids[runs + k]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            by_length: dict[int, list[int]] = {}
            for p, k in zip(runs[hit].tolist(), at[hit].tolist()):
                for length in self.lengths[k]:
                    by_length.setdefault(length, []).append(p)
            for length, places in by_length.items():
                self._search(words, length, np.array(places), best)
        return [(item, *found) for item, found in best.items()]

    def _search(self, words: list[str], length: int, places: np.ndarray, best: dict) -> None:
        size = min(length, len(words))
        last = len(words) - size
        low, high = np.maximum(places - size + WIDTH, 0), np.minimum(places, last)
        while len(places):  # stretches of text whose windows touch
            end = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1] + size)
            cut = int(end[0]) + 1 if len(end) else len(places)
            taken = np.zeros(int(high[:cut].max()) - int(low[0]) + 2, np.int64)
            np.add.at(taken, low[:cut] - low[0], 1)
            np.add.at(taken, high[:cut] - low[0] + 1, -1)
            starts = np.flatnonzero(np.cumsum(taken)[:-1] > 0)
            first = int(low[0])
            self._stretch(words[first : first + int(starts[-1]) + size], first, starts, size, self.by_length[length], best)
            places, low, high = places[cut:], low[cut:], high[cut:]

    def _stretch(self, words: list[str], first: int, starts: np.ndarray, size: int, own: dict, best: dict) -> None:
        h, weight = shingles(words)
        upto = np.r_[0.0, np.cumsum(weight)]
        span = size - WIDTH + 1
        prints = _window_prints(h, weight, starts, span)
        cells = prints.view(np.uint8).reshape(-1, BLOCKS)
        pairs = []
        for b, (begin, items) in enumerate(own["blocks"]):
            a, z = begin[cells[:, b]], begin[cells[:, b].astype(np.int64) + 1]
            count = z - a
            row = np.repeat(np.arange(len(prints)), count)
            pairs.append(row * len(own["ids"]) + items[np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())])
        row, item = np.divmod(np.unique(np.concatenate(pairs)), len(own["ids"]))
        distance = np.bitwise_count(prints[row] ^ own["prints"][item])
        close = distance <= self.radius
        order = np.argsort(distance[close], kind="stable")
        values = h.tolist()
        for r, k, d in zip(row[close][order].tolist(), item[close][order].tolist(), distance[close][order].tolist()):
            name = own["ids"][k]
            if name in best and best[name][0] >= 1.0:
                continue
            at = int(starts[r])
            similarity = weighted_similarity(Counter(values[at : at + span]), float(upto[at + span] - upto[at]), *own["bags"][k])
            if similarity >= self.similarity and (name not in best or similarity > best[name][0]):
                best[name] = (similarity, d, first + at, size)


def weighted_similarity(window: Counter, window_weight: float, item: Counter, weights: dict[int, float], item_weight: float) -> float:
    """The weight of the shingles that both have, as often as both have them, over that of all of both."""
    both = sum(weights[x] * min(n, item[x]) for x, n in window.items() if x in item)
    return both / (window_weight + item_weight - both)


def _indexes(benchmark: DataFrame, *, similarity: float, radius: int, block_items: int, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark's blocks as broadcast indexes; one empty index for an empty benchmark."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows], radius=radius, similarity=similarity))


def contaminations(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, radius: int = 23, block_items: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, similarity, distance, first_word, n_words)``.

    A row for each document and each item of which the document holds a window of the item's number of words with
    a weighted five-word-shingle similarity (Jaccard over counts; shingles of longer and different words weigh more) of ``similarity`` or more; the
    best window is given. Windows are found by SimHash: every fingerprint within ``radius`` bits of an
    item's is led to it by one of its blocks at least, and the exact similarity decides. At 0.8 fingerprints differ
    in about 10 bits, with a deviation of 3: a radius of 23 is four and a half deviations above. A radius of 64 compares
    every window with every item of its length and is exact.

    The benchmark is taken in blocks of ``block_items`` items and ``block_chars`` characters at most on average; a block is what
    tasks hold (an item is held whole), and the documents are read once for each; what is found doesn't depend on the blocks. Items of fewer than five words must occur word for word;
    items without a word (null, empty) are found nowhere, as are windows in null or empty texts. Equal items are
    reported each. Repeated rows of documents give repeated rows; an empty benchmark gives no rows.
    """
    found = None
    for held in _indexes(benchmark, similarity=similarity, radius=radius, block_items=block_items, block_chars=block_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"]
            for b in batches:
                out = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in index.find(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def _clean(held: Broadcast):
    """Whether texts hold no item of a block."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([not held.value.find(t) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(of, "boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, radius: int = 23, block_items: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` in whose texts ``contaminations`` finds no item, with all columns.

    Each text is judged where it is read, by one block of the benchmark after the other: no text is shuffled. Null and empty texts
    stay, as do all rows if the benchmark is empty; repeated rows fare alike, and rows without doc_id like others.
    """
    for held in _indexes(benchmark, similarity=similarity, radius=radius, block_items=block_items, block_chars=block_chars):
        docs = docs.where(_clean(held)("text"))
    return docs
