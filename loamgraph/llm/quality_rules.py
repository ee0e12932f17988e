"""Quality rules judged by an isolation forest over rule statistics."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import hash_share, stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The rule statistics that the forest splits on, each free of the text's length.
FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "bangs", "distinct", "longest", "line_words"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BINS = 1000

_UPPER, _DIGIT, _STOP, _BANG = (s.encode() for s in (string.ascii_uppercase, string.digits, ".,;:?", "!"))


def repeated_words(words: list, width: int = 3) -> int:
    """How many words stand in windows of ``width`` words that the list holds twice or more, the first ones included."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    hit = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + width] = True
            hit[j : j + width] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, then FEATURES, of one whole text; null counts as empty, and a text without words has features of 0."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(FEATURES))
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    return (
        n, word_chars, symbols, dup_lines, repeats,
        word_chars / n, symbols / word_chars, dup_lines / len(lines), repeats / n, share(_UPPER), share(_DIGIT), share(_STOP), share(_BANG),
        len(set(words)) / n**0.8, float(np.log(max(map(len, words)))), float(np.log(n / len(lines))),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id and one column for each of COUNTS (long) and FEATURES (double)."""
    names = COUNTS + FEATURES

    def of(texts: pa.Array) -> pa.Array:
        cols = list(zip(*map(statistics, texts.to_pylist()))) or [[]] * len(names)
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])
    return docs.select("doc_id", F.arrow_udf(of, schema)("text").alias("s")).select("doc_id", "s.*")


def _mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search among n keys."""
    m = np.maximum(n, 2) - 1
    return np.where(n <= 1, 0.0, 2 * (np.log(m) + 0.5772156649) - 2 * m / (m + 1))


class Forest:
    """Isolation trees in heap order: node k has children 2k+1 and 2k+2; leaves hold the path length."""

    def __init__(self, sample: np.ndarray, *, trees: int = 100, per_tree: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(per_tree, len(sample)))))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.split, self.path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            rows = sample[rng.choice(len(sample), min(per_tree, len(sample)), replace=False)]
            self._grow(t, 0, 0, rows, rng)
        self.norm = float(_mean_path(np.array([min(per_tree, len(sample))]))[0]) or 1.0

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth >= self.depth or len(rows) <= 1 or not len(wide):
            self.path[t, node] = depth + _mean_path(np.array([len(rows)]))[0]
            return
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, cut
        left = rows[:, f] < cut
        self._grow(t, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The anomaly of each row: 2 to the power of minus its mean path length over the usual one."""
        total = np.zeros(len(x))
        at_row = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[at_row, np.maximum(f, 0)] >= split[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def related(x: np.ndarray, quality: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Which columns order the labels better than chance: those whose rank statistic is ``least`` or more off one half."""
    bad, good = x[quality == 0], x[quality == 1]
    if not len(bad) or not len(good):
        return np.ones(x.shape[1], bool)
    keep = []
    for k in range(x.shape[1]):
        at = np.sort(good[:, k])
        below = (np.searchsorted(at, bad[:, k], "left") + np.searchsorted(at, bad[:, k], "right")) / 2
        keep.append(abs(below.mean() / len(at) - 0.5) >= least)
    return np.array(keep) if any(keep) else np.ones(x.shape[1], bool)


def fit_forest(known: DataFrame, *, sample_rows: int, leasts: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4), **params) -> tuple[Forest, list[str]] | None:
    """A forest over at most ``sample_rows`` rows of ``known``, in the order of a hash of the id, and the statistics it splits on.

    Statistics that the labels of those rows show to have little to do with quality (a telephone number's digits,
    say) are left out: a row may be odd in them and good. How much is little is calibrated too: of ``leasts``,
    the first whose forest parts the labels best.
    """
    some = hash_share(known, sample_rows, "forest", n=known.count())
    rows = some.orderBy("__order", "doc_id").limit(sample_rows).select(*FEATURES, "quality").collect()
    if len(rows) < 8:
        return None
    x = np.array(rows, float)
    x, quality = x[:, :-1], x[:, -1]
    best = None
    for least in leasts:
        keep = related(x, quality, least)
        forest = Forest(x[:, keep], **params)
        score = forest.score(x[:, keep])
        bad, good = np.sort(score[quality == 0]), np.sort(score[quality == 1])
        gain = 0.0
        if len(bad) and len(good):
            gain = max((np.searchsorted(good, score) / len(good) - np.searchsorted(bad, score) / len(bad)).max(), 0.0)
        if best is None or gain > best[0] + 0.002:
            best = gain, forest, [f for f, k in zip(FEATURES, keep) if k]
    return best[1:]


def threshold(scored: DataFrame) -> float:
    """The anomaly from which a document is rejected, from all rows of ``scored(anomaly, quality)``.

    Of BINS steps of the anomaly, the one with the greatest sum of rejected shares of quality 0 and kept shares of
    quality 1; without both labels, 1.0, which rejects nothing.
    """
    hist = scored.groupBy((F.floor(F.col("anomaly") * BINS)).cast("int").alias("bin"), "quality").count().collect()
    bad, good = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, quality, n in hist:
        (good if quality else bad)[b] += n
    if not bad.sum() or not good.sum():
        return 1.0
    gain = np.cumsum(bad[::-1])[::-1] / bad.sum() - np.cumsum(good[::-1])[::-1] / good.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)  # where nothing lies between the labels, the middle
    return float(best[0] + best[-1]) / 2 / BINS if gain.max() > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 16_384, trees: int = 100, per_tree: int = 256) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> doc_id, COUNTS, base_failed, anomaly, kept: a row for each row.

    The statistics cover every whole text. The forest is fitted on ``sample_rows`` labelled rows at most (the
    bound of what reaches the driver) that pass the base rules; the threshold comes from all labelled rows that do.
    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows. Such rows aren't kept,
    nor those whose anomaly reaches the threshold. Null and empty texts have no words and fail. A doc_id with several labels has
    its lowest quality; of its rows that pass the base rules the one with the least statistics, in their order, is held against it. With fewer than 8 labelled rows, or labels of one kind, the base rules alone decide (anomaly 0).
    """
    rows = stored(rule_statistics(docs), "rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Of several rows of one labelled id the least by its statistics is looked at, whatever the order of rows.
    rest = [c for c in rows.columns if c != "doc_id"]
    known = rows.where(~failed).join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "quality", "r.*")
    fitted = fit_forest(known, sample_rows=sample_rows, trees=trees, per_tree=per_tree)
    if fitted is None:
        anomaly, limit = F.lit(0.0), 1.0
    else:
        forest, split_on = fitted

        def of(*cols: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in cols], axis=1)
            return pa.array(forest.score(x))

        anomaly = F.arrow_udf(of, "double")(*split_on)
        limit = threshold(known.select("quality", anomaly.alias("anomaly")))
    out = rows.select("doc_id", *COUNTS, failed.alias("base_failed"), anomaly.alias("anomaly"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
