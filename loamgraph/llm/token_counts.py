"""Token counts: dynamic programming over prefixes gives the exact number of tokens of every prefix of a text."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The vocabulary, by its name among the public tokenizers or by a path that every machine has.
TOKENIZER = "byte_bpe_50k.json"
#: Entries that a worker keeps of each table of things it has worked out (stretches of text, neighbouring tokens), and the longest stretch kept.
KEPT, KEPT_CHARS = 1 << 19, 48
#: Texts of characters below this one are cut by the tokenizer's public pattern; all versions of Unicode agree on them.
BEYOND, LATIN_PIECE = "\u0250", regex.compile(public_tokenizers.PATTERN)
#: The bytes that vocabularies of this kind show as the characters of their numbers; others are shown by characters from 256 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}


def _values(steps: bytes) -> list[int]:
    return [b - 256 if b > 127 else b for b in steps]


def _steps(counts: list[int]) -> bytes:
    return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])


class Counter:
    """Counts of the tokens that byte-level BPE gives for every prefix of a text, in code points.

    The last token of a prefix settles the rest: what stands before it is tokenized as that shorter prefix is. A token can be the last one
    if, next to the last token of the shorter prefix, merging both anew leaves them as they are; one token alone can for each prefix.
    So ``count[k] = count[k - len(token)] + 1``, from left to right, and no prefix is encoded again.
    """

    def __init__(self, path: str) -> None:
        told = json.load(open(path, encoding="utf-8"))
        model = told["model"]
        if told["normalizer"] or model["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: byte-level BPE without a normalizer is needed")
        added = [a["content"] for a in told["added_tokens"] if a["special"]]
        if len(added) != 1 or len(added) != len(told["added_tokens"]):
            raise ValueError(f"{path}: one special token is needed")
        self.special = added[0]
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        hidden = [k for k in range(256) if k not in SHOWN]
        self.byte = {k: chr(k if k in SHOWN else 256 + hidden.index(k)) for k in range(256)}
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.made = {a + b: (k, (a, b)) for (a, b), k in self.rank.items()}
        self.longest = max(map(len, model["vocab"]))
        if self.longest > 128:  # a step down is less than the longest token, so it fits a byte
            raise ValueError(f"{path}: a token of {self.longest} bytes")
        whole = [t for t in model["vocab"] if self._merged(list(t)) == [t]]  # others never come out of merging
        self.found = ahocorasick.Automaton()
        for t in whole:
            self.found.add_word(t, t)
        self.found.make_automaton()
        self.together: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text within which tokens merge. The library tells classes of characters beyond Latin letters, on which versions of Unicode differ."""
        if max(text, default="") < BEYOND:
            return LATIN_PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library_cut(text)]

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stand(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are next to each other.

        They are taken apart from the last merge back to the first: of the two at the border, the one merged later. Two that meet
        on the way, and would merge before what was taken apart last, would have merged across the border (of equal merges the left one goes first).
        """
        if len(self.together) >= 4 * KEPT:
            self.together.clear()
        x, y, before, stays = left, right, len(self.rank), True
        while stays:
            stays = self.rank.get((x, y), before) >= before
            (made_x, x_end), (made_y, y_end) = self.made.get(x, (-1, "")), self.made.get(y, (-1, ""))
            if made_x == made_y == -1:
                break
            if made_x > made_y:
                x, before = x_end[1], made_x
            else:
                y, before = y_end[0], made_y + 1
        self.together[left, right] = stays
        return stays

    def _tokens(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece; a character of ``piece`` stands for a byte."""
        count, last, stand = [0] * (len(piece) + 1), [""] * (len(piece) + 1), self.together.get
        for end, token in self.found.iter(piece):
            end += 1
            if last[end]:
                continue
            before = end - len(token)
            if before:
                stays = stand((last[before], token))
                if not (self._stand(last[before], token) if stays is None else stays):
                    continue
            count[end], last[end] = count[before] + 1, token
        return count

    def _piece(self, piece: str) -> bytes:
        """Steps of a piece: one signed byte for each character, by how much the count changes there."""
        known = self.pieces.get(piece)
        if known is None:
            of = self._tokens(piece.encode().decode("latin-1").translate(self.byte))
            if not piece.isascii():
                of = [of[k] for k in accumulate((len(c.encode()) for c in piece), initial=0)]
            known = self._keep(self.pieces, piece, _steps(of))
        return known

    def steps_of(self, text: str) -> bytes:
        """Steps of the characters of a text without the special token.

        Pieces are cut as the library does. A prefix is cut like the text but at its end: white space that ends it is one piece, although
        before a word its last character is another one's; and a contraction whose last letter is missing falls into two.
        """
        pieces = self.cut(text)
        out = [self._piece(p) for p in pieces]
        for k, own in enumerate(pieces):
            if own[0] == "'" and len(own) == 3 and len(halves := self.cut(own[:2])) == 2:
                of = [0, *accumulate(_values(out[k]))]
                of[2] = sum(sum(_values(self._piece(p))) for p in halves)
                out[k] = _steps(of)
        for k, own in enumerate(pieces):
            if k and own[0].isspace() and pieces[k - 1].isspace() and len(self.cut(joined := pieces[k - 1] + own[0])) == 1:
                of = [0, *accumulate(_values(out[k]))]
                of[1], true = sum(_values(self._piece(joined))) - sum(_values(self._piece(pieces[k - 1]))), of[1]
                out[k] = _steps(of)
                if len(own) == 1:  # the next piece begins from the count without the prefix's own end
                    own = _values(out[k + 1])
                    out[k + 1] = _steps([0, *accumulate([own[0] + true - of[1], *own[1:]])])
        return b"".join(out)

    def _keep(self, table: dict[str, bytes], key: str, steps: bytes) -> bytes:
        if len(key) <= KEPT_CHARS:
            if len(table) >= KEPT:
                table.clear()
            table[key] = steps
        return steps

    def _stretch(self, part: str) -> bytes:
        """Steps of ``part`` after a space, both between characters that aren't white space."""
        lines = part.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            # A line end between such characters is a piece of its own, so lines are cut alone, too.
            first = self.spaced.get(lines[0]) or self._stretch(lines[0])
            return first + b"".join([self.spaced.get(x) or self._keep(self.spaced, x, self.steps_of(x)) for x in ["\n" + x for x in lines[1:]]])
        return self._keep(self.spaced, part, self.steps_of(" " + part))

    def _section(self, text: str) -> tuple[list[bytes], int]:
        """(steps, a place from which on the text is cut as alone) of a text without the special token.

        A space between two characters that aren't white space begins a piece, so the stretches from one such space to the next are
        cut alone, and most of them are known.
        """
        parts = text.split(" ")
        known = list(map(self.spaced.get, parts))
        known[0], k, begin = None, 0, 0
        while True:
            try:
                k = known.index(None, k)
            except ValueError:
                break
            part = parts[k]
            if k and part and not part[0].isspace() and not part[-1].isspace():
                known[k] = self._stretch(part)
                k += 1
                continue
            held, first = (" " + part if k else part), k
            while k + 1 < len(parts) and (not held or held[-1].isspace() or not parts[k + 1] or parts[k + 1][0].isspace()):
                k += 1
                held += " " + parts[k]
                known[k] = b""
            known[first] = self.steps_of(held)
            begin = first
            k += 1
        last = max(begin, len(parts) - 1 if known[-1] else begin)
        return known, sum(map(len, parts[:last])) + max(0, last - 1)

    def steps(self, text: str) -> bytes:
        """One signed byte for each character: by how much the number of tokens of the prefix changes there."""
        sections = text.split(self.special)
        out = []
        for k, section in enumerate(sections):
            known, begin = self._section(section)
            out += known
            if k < len(sections) - 1:
                # Prefixes that end inside the special token hold a part of it as ordinary text.
                held = section[begin:]
                before = sum(_values(self.steps_of(held))) if held else 0
                of = list(accumulate(_values(self.steps_of(held + self.special[:-1]))))[-len(self.special) + 1 :]
                out.append(_steps([before, *of, before + 1]))
        return b"".join(out)


@lru_cache(maxsize=2)
def counter(tokenizer: str) -> Counter:
    return Counter(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))


def prefix_steps(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """``struct(n_tokens long, steps array<tinyint>)`` of a text column.

    ``n_tokens`` is what the library gives for the whole text, without added tokens, the special token inside the text counted as one.
    ``steps`` has one entry for each code point: the sum of the first k is the number of tokens of the first k characters. Null
    counts as empty: no steps, no tokens. A step needs a byte at most, so what is stored is about as large as the text.
    """

    def of(texts: pa.Array) -> pa.Array:
        c = counter(tokenizer)
        found = [c.steps(t) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        if ends[-1] >= 1 << 31:
            raise ValueError("a batch of over 2^31 characters; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int8)))
        n = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in found]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), steps], ["n_tokens", "steps"])

    return F.arrow_udf(of, "n_tokens long, steps array<tinyint>")(text)


def prefix_table(docs: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs(text, ...)`` -> its columns (but ``n_tokens`` and ``steps``, which are replaced), ``n_tokens`` and ``steps`` of each row.

    Rows are counted one by one where they lie: nothing is shuffled, and repeated rows, equal or missing ids and other columns make no
    difference. Stored, the table answers ``tokens_at``, ``fitting`` and ``truncated`` without the tokenizer. No rows give no rows.
    """
    rows = docs.drop("n_tokens", "steps").withColumn("__counted", prefix_steps(F.col("text"), tokenizer))
    return rows.select(*[c for c in rows.columns if c != "__counted"], "__counted.n_tokens", "__counted.steps")


def tokens_at(steps: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters: 0 for none of them, all for more than there are; null for null steps."""
    k = F.lit(chars) if isinstance(chars, int) else chars
    return F.aggregate(F.slice(steps, F.lit(1), F.greatest(k, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def fitting(steps: Column, budget: Column | int) -> Column:
    """The length of the longest prefix of at most ``budget`` tokens, in characters.

    Counts may fall from a prefix to a longer one (a word's last letter may merge it to one token), so all prefixes are looked at, and
    the last one that fits counts. 0 where none does; null for null steps.
    """
    most = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n, at = a["n"] + x, a["at"] + 1
        return F.struct(n.alias("n"), at.alias("at"), F.when(n <= most, at).otherwise(a["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda a: a["best"])


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """``prefix_table`` rows with each text cut to its longest prefix of at most ``budget`` tokens; ``n_tokens`` and ``steps`` are those of the cut text.

    The steps of a prefix are a prefix of the steps, so that nothing is counted anew. Null texts stay null.
    """
    rows = table.withColumn("__fit", fitting(F.col("steps"), budget))
    rows = rows.withColumn("text", F.substring("text", F.lit(1), F.col("__fit"))).withColumn("n_tokens", tokens_at(F.col("steps"), F.col("__fit")))
    return rows.withColumn("steps", F.slice("steps", F.lit(1), F.col("__fit"))).drop("__fit")


def digest(table: DataFrame, *, limit: int = 1024) -> DataFrame:
    """``prefix_table`` rows -> ``(doc_id, n_bytes, n_tokens, over_limit)``: whether a text has more than ``limit`` tokens; 0 bytes for null."""
    n = F.col("n_tokens")
    return table.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n, (n > limit).alias("over_limit"))
