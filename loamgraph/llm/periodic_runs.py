"""Periodic runs of words: Lempel-Ziv blocks cover the leftmost squares, suffix-link walks complete them, occurrences merge into runs."""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words.
LEAST = 12
#: Words of the windows whose repetition tells where runs may lie; ``LEAST`` must be 3 * GRAM or more.
GRAM = 4


def _agreement(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of ``text``: how many items from there on are the first ones of ``pattern`` (the usual Z algorithm)."""
    t = [*pattern, -1, *text]
    n, z = len(t), [0] * len(t)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and t[k] == t[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[len(pattern) + 1 :]


class SuffixTree:
    """The suffix tree of a list of small integers, with suffix links (Ukkonen's construction), leaves in order, and least positions below nodes."""

    def __init__(self, items: list[int]) -> None:
        s = self.s = [*items, -1]
        n = len(s)
        self.begin, self.end, self.link, self.next = [0], [0], [0], [{}]  # node 0 is the root; end -1: a leaf's edge, which goes to the end
        begin, end, link, children = self.begin, self.end, self.link, self.next
        node, edge, length, pending = 0, 0, 0, 0
        for i in range(n):
            c, pending, inner = s[i], pending + 1, 0
            while pending:
                if not length:
                    edge = i
                child = children[node].get(s[edge])
                if child is None:
                    children[node][s[edge]] = len(begin)
                    begin.append(i), end.append(-1), link.append(0), children.append(None)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    size = (end[child] if end[child] >= 0 else i + 1) - begin[child]
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if s[begin[child] + length] == c:
                        if inner:
                            link[inner] = node
                        length += 1
                        break
                    split = len(begin)
                    begin.append(begin[child]), end.append(begin[child] + length), link.append(0), children.append({s[begin[child] + length]: child, c: split + 1})
                    children[node][s[edge]] = split
                    begin.append(i), end.append(-1), link.append(0), children.append(None)
                    begin[child] += length
                    if inner:
                        link[inner] = split
                    inner = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - pending + 1
        self._measure(n)

    def _measure(self, n: int) -> None:
        """Depths, parents, the stretch of leaves below each node, and the least of their positions."""
        size = len(self.begin)
        self.parent, self.depth = [0] * size, [0] * size
        self.low, self.high, self.least = [0] * size, [0] * size, [n] * size
        self.leaves, self.leaf_of, order, todo = [], [0] * n, [], [0]
        begin, end, depth, parent = self.begin, self.end, self.depth, self.parent
        while todo:
            v = todo.pop()
            order.append(v)
            self.low[v] = len(self.leaves)
            below = self.next[v]
            if below is None:
                at = self.least[v] = n - depth[v]
                self.leaf_of[at] = v
                self.leaves.append(at)
                continue
            for w in below.values():
                parent[w], depth[w] = v, depth[v] + (end[w] if end[w] >= 0 else n) - begin[w]
                todo.append(w)
        for v in reversed(order):
            if self.next[v] is None:
                self.high[v] = self.low[v] + 1
            else:
                self.high[v] = max(self.high[w] for w in self.next[v].values())
            p = parent[v]
            if self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks, and the end: each block is the longest stretch that begins earlier, too, or one new item."""
        out, h, n = [], 0, len(self.s) - 1
        while h < n:
            out.append(h)
            v, long = 0, 0
            while h + long < n:
                w = self.next[v].get(self.s[h + long]) if self.next[v] is not None else None
                if w is None or self.least[w] >= h:
                    break
                v, long = w, self.depth[w]
            h += max(1, min(long, n - h))
        return [*out, n]

    def climb(self, at: int, long: int) -> int | None:
        """The node at or just below the end of the stretch of ``long`` items from ``at``; None if the stretch occurs earlier."""
        v = self.leaf_of[at]
        while self.depth[self.parent[v]] >= long:
            v = self.parent[v]
            if self.least[v] < at:
                return None
        return v if self.least[v] == at else None

    def rotated(self, v: int, long: int) -> int | None:
        """From the square of ``long`` items that ends at or just above ``v``: the place of the square whose first item moved to the end; None if it doesn't occur."""
        at = self.least[v]
        u = self.parent[v]
        w = self.link[u] if u else 0
        done, want, s = self.depth[w], long - 1, self.s
        while done < want:
            w = self.next[w][s[at + 1 + done]]
            done = self.depth[w]
        first = s[at]
        if done == want:
            return self.next[w].get(first) if self.next[w] is not None else None
        return w if s[self.least[w] + want] == first else None


def leftmost_squares(s: list[int], blocks: list[int]) -> dict[int, list[int]]:
    """Half length -> starts of squares, such that every square's leftmost occurrence is reached from one of them by moving right over squares.

    A square's leftmost occurrence has its middle in some block and doesn't reach beyond the next one. For each block, squares that
    its end or its start splits are found from agreements to the right and to the left of that place.
    """
    out, back, n = defaultdict(list), s[::-1], len(s)
    for b in range(len(blocks) - 1):
        h, h1 = blocks[b], blocks[b + 1]
        size = h1 - h
        # Squares with the start of their second half at or before the end of the block.
        if h1 < n:
            ahead = _agreement(s[h1 : h1 + size], s[h:h1])
            behind = _agreement(back[n - h1 : n - h1 + size], back[n - h1 : n - h1 + 2 * size])
            for k in range(1, size + 1):
                q = h1 - k
                k1, k2 = ahead[q - h], (behind[k] if k < len(behind) else 0)
                if k1 + k2 >= k:
                    out[k].append(q - min(k2, k))
        # Squares with their first half over the start of the block.
        most = (blocks[b + 2] if b + 2 < len(blocks) else n) - h
        ahead = _agreement(s[h : h + most], s[h : h + 2 * most])
        behind = _agreement(back[n - h : n - h + most], back[n - h - most : n - h])
        for k in range(1, most + 1):
            if h + k >= n:
                break
            k1, k2 = ahead[k], behind[most - k]
            if k1 + k2 >= k:
                out[k].append(h - min(k2, k))
    return out


class _Reach:
    """Stretches, and whether one of them holds another stretch: greatest ends by start, in a Fenwick tree."""

    def __init__(self, n: int) -> None:
        self.best = [0] * (n + 1)

    def add(self, start: int, end: int) -> None:
        k = start + 1
        while k < len(self.best):
            if self.best[k] < end:
                self.best[k] = end
            k += k & -k

    def holds(self, start: int, end: int) -> bool:
        k = start + 1
        while k:
            if self.best[k] >= end:
                return True
            k &= k - 1
        return False


def all_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of small integers: period the smallest, length twice the period or more, neither end extensible.

    Half lengths are taken in ascending order. Squares inside a run of a smaller period repeat a shorter stretch, give no run of their own, and aren't
    walked; occurrences of the others are n log n at most. Occurrences at neighbouring places belong to one run.
    """
    if len(s) < 2:
        return []
    tree = SuffixTree(s)
    starts, known, out = leftmost_squares(s, tree.blocks()), _Reach(len(s)), []
    for k in sorted(starts):
        seen, at = set(), []
        for i in set(starts[k]):
            if known.holds(i, i + 2 * k):
                continue
            v = tree.climb(i, 2 * k)
            while v is not None and v not in seen:
                seen.add(v)
                at += tree.leaves[tree.low[v] : tree.high[v]]
                v = tree.rotated(v, 2 * k)
        at.sort()
        first = 0
        for j in range(1, len(at) + 1):
            if j == len(at) or at[j] != at[j - 1] + 1:
                run = at[first], at[j - 1] + 2 * k - at[first], k
                out.append(run)
                known.add(run[0], run[0] + run[1])
                first = j
    return out


def _stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches of words in which all runs of ``LEAST`` words or more lie: those covered by windows of ``GRAM`` words that occur again.

    A run's windows occur again one period on or back, but for those over the middle of a run of two periods, whose words are in other windows that do.
    """
    n = len(words)
    if n < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    g = h[: n - GRAM + 1].copy()
    for j in range(1, GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n - GRAM + 1 + j]
    order = np.argsort(g)
    equal = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    if not len(equal):
        return []
    edge = np.zeros(n + 1, np.int64)
    again = np.union1d(order[equal], order[equal + 1])
    np.add.at(edge, again, 1)
    np.add.at(edge, again + GRAM, -1)
    held = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
    begin, end = np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(~held[1:] & held[:-1])
    return [(a, z) for a, z in zip(begin.tolist(), end.tolist()) if z - a >= LEAST]


def runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` (12 at least) or more words, by start, then period."""
    out = []
    for a, z in _stretches(words):
        ids: dict[bytes, int] = {}
        s = [ids.setdefault(w, len(ids)) for w in words[a:z]]
        out += [(a + i, long, p) for i, long, p in all_runs(s) if long >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by a checksum of the id, with their tail replaced by repetitions of its beginning; those of others as they are.

    A null id counts as no id: the words stay.
    """
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * ((n - a) // p + 1))[: n - a]]


def _found(doc_id: int | None, text: str | None, planted: bool) -> tuple:
    words = text.encode().split() if text else []
    if planted:
        words = repeated_tail(doc_id, words)
    found = runs(words)
    if found:
        gone = bytearray(len(words))
        for start, long, period in found:
            gone[start + period : start + long] = b"\1" * (long - period)
        words = [w for w, out in zip(words, gone) if not out]
    start, long, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return found, b" ".join(words).decode(), len(found), start, long, period, listed


FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed string, n_runs long, start long, length long, period long, listed string"


def run_columns(doc_id: Column, text: Column, *, planted: bool = False) -> Column:
    """A struct of ``FOUND``: all runs of a text's words by start and period, the text without repetitions, the longest run (ties: smallest start, then period), and the runs as lines.

    Words are stretches without ASCII white space. A word is dropped if a run holds it after that run's first period; what stays is joined by one space.
    Null counts as empty. A text is worked on whole, in time and memory about linear in its repeated stretches
    (about half a kB for each of their words); texts without repeated windows of four words cost a sort of hashes.
    """

    def of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [_found(i, t, planted) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        names = [f.split(" ")[0] for f in FOUND.replace("start:long,length:long,period:long", "").split(", ")]
        each = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        kinds = [pa.list_(each), pa.string(), *[pa.int64()] * 4, pa.string()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        columns[0] = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in columns[0]]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(of, FOUND)(doc_id, text)


def periodic_runs(docs: DataFrame, *, planted: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, runs, collapsed, n_runs, start, length, period, listed)``, a row for each row.

    ``planted``: tails of a tenth of the documents are repeated first (``repeated_tail``). Rows are judged one by one where they lie, so equal or
    missing ids, repeated rows and other columns make no difference, and nothing is shuffled. No rows give no rows.
    """
    return docs.select("doc_id", run_columns(F.col("doc_id"), F.col("text"), planted=planted).alias("r")).select("doc_id", "r.*")


def digest(found: DataFrame) -> DataFrame:
    """``periodic_runs`` rows with checksums in place of runs and texts, and ``exponent_milli``, the longest run's length in thousandths of its period."""
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent, F.sha2(F.col("listed"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
