"""Operators 11, 12 and 13 against brute force, SQL and the tokenizer's library."""

import hashlib
import random
from itertools import accumulate
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamgraph.llm import periodic_runs, token_counts, vector_codes
from loamgraph.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect

ODD = ["", None, " \t\n", "one", "a b a b a b a b a b a b", "x\x0by\x0cz\r\nx y z", "é" * 70000, "ab " * 9000, "a <|endoftext|> b", "<|endoftext|><|endof", "it's  \n we'll\t'v 中文🙂 ", "---- " * 300]


def clashing(spark, rows):
    """Documents with columns named as those of the operators."""
    return spark.createDataFrame([(i, t, 5, "x", 0) for i, t in rows], "doc_id long, text string, n_tokens int, steps string, start int")


# --- 11


def brute_codes(rows, entries=256, rounds=4):
    """Vectors as lists of numbers -> codes, errors, sums by label and codebooks, one row and component after the other."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // 4
    cut = [[v[p * w : p * w + w] for p in range(4)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(4)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(4):
            held = {}
            for c in cut:
                held.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for k, parts in held.items():
                new[p][k] = [sum(x) // len(parts) for x in zip(*parts)]
        books = new
    out, by = {}, {}
    for (i, _, lab), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(4)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab
        by[lab] = by.get(lab, 0) + out[i][1]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {(i, code, error, by[lab], sha) for i, (code, error, lab) in out.items()}


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int"


def test_vector_codes_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i * 3 % 701, [round(rnd.gauss(0, 1), 2) for _ in range(8)], rnd.choice([0, 1, 1, 1, None])) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1], 1) for i in range(60)]  # repeated vectors, so equal distances and unused entries
    rows += [(2001, None, 1), (2002, [None] + [1.0] * 7, 1), (2003, [float("nan")] + [1.0] * 7, 0), (2004, [float("-inf")] + [0.0] * 7, 0)]
    got = vector_codes.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(7))
    assert {tuple(r) for r in got.collect()} == brute_codes(rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "x", 1)], VECTORS)).collect() == []
    odd = [(5, [0.5] * 8, None, "", 0), (5, [0.5] * 8, None, "", 0), (None, [0.25] * 8, None, "", 0), (9, [1.0] * 3, 2, "", 0)]
    got = sorted((tuple(r)[:4] for r in vector_codes.compress(spark.createDataFrame(odd, VECTORS)).collect()), key=str)
    assert got == sorted([(5, "00000000", 0, 0), (5, "00000000", 0, 0), (None, "02020202", 0, 0), (9, None, None, None)], key=str)
    assert vector_codes.compress(spark.createDataFrame([(1, [], 1, "", 0)], VECTORS)).first()["code"] == "00000000"


def test_distances_are_exact_at_the_largest_components():
    x = np.full((1, 16), vector_codes.LARGEST)
    assert vector_codes.nearest(x, -x)[1].tolist() == [16 * (2 * vector_codes.LARGEST) ** 2]


def test_vector_codes_equal_their_sql(spark, sf_dir):
    assert_same(QUERIES["op11_vector_codes"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op11_vector_codes"])


# --- 12


def brute_runs(s, least=0):
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            long = i + q - a
            if i > a and long >= max(least, 2 * q) and not any(all(s[j] == s[j + d] for j in range(a, a + long - d)) for d in range(1, q)):
                out.append((a, long, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    for _ in range(1500):
        n = rnd.randint(0, 40)
        s = [rnd.randrange(rnd.choice([1, 2, 2, 3])) for _ in range(n)]
        if n and rnd.random() < 0.4:
            i, p = rnd.randrange(n), rnd.randint(1, 8)
            s = [s[j] if j < i or i + p > n else s[i + (j - i) % p] for j in range(n)]
        assert sorted(periodic_runs.all_runs(s), key=lambda r: (r[0], r[2])) == brute_runs(s)


def test_runs_of_words_lie_in_the_stretches():
    rnd = random.Random(12)
    for _ in range(800):
        n = rnd.randint(0, 90)
        s = [str(rnd.randrange(rnd.choice([2, 3, 6, 30]))).encode() for _ in range(n)]
        for _ in range(2):
            i, p, m = rnd.randrange(n + 1), rnd.randint(1, 12), rnd.randint(1, 40)
            s = [s[i + (j - i) % p] if i <= j < i + m and i + p <= n else s[j] for j in range(n)]
        assert periodic_runs.runs(s) == brute_runs(s, 12)


def test_squares_of_long_periods_and_of_one_word():
    assert periodic_runs.all_runs([0] * 3000) == [(0, 3000, 1)]
    assert periodic_runs.all_runs(list(range(700)) * 3 + [0, 1]) == [(0, 2102, 700)]
    fib = ["1", "0"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    s = [int(c) for c in fib[-1]]
    assert sorted(periodic_runs.all_runs(s), key=lambda r: (r[0], r[2])) == brute_runs(s)


def test_run_digests_equal_brute_force(spark):
    rnd = random.Random(13)
    texts = ODD + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 160))) for _ in range(120)]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(None, "p q " * 9), (7, "p q " * 9), (7, "p q " * 9)]
    got = sorted((tuple(r) for r in periodic_runs.digest(periodic_runs.periodic_runs(clashing(spark, rows), planted=True)).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        n, h = len(w), crc32(str(i).encode())
        if i is not None and n and h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w, 12) if len(w) < 2000 else periodic_runs.runs(w)
        gone = {j for a, m, q in found for j in range(a + q, a + m)}
        first = min(((-m, a, q) for a, m, q in found), default=None)
        best = (first[1], -first[0], first[2], 1000 * -first[0] // first[2]) if first else (None,) * 4
        sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{m},{q}\n" for a, m, q in found).encode(), b" ".join(x for j, x in enumerate(w) if j not in gone))]
        want.append((i, len(found), *best, *sha))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 10
    none = periodic_runs.periodic_runs(clashing(spark, rows).where("false"))
    assert none.count() == 0 and none.columns[0] == "doc_id"


# --- 13


def library(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


BITS = ["Ā", "ɏ", "ɐ", "\xa0", "a", "b", " ", "  ", "\n", "\t", "'re", "'s", "'", "!", "1", "é", "中", "🙂", "　", "<|endoftext|>", "<|endof", "the", " hello", "\r\n", "-----", "\x1c", "՘", "'ll", "'v", "\x00", "word.", "aaaa", "  \n ", "\x85"]


def test_every_prefix_has_the_librarys_count():
    rnd = random.Random(14)
    c = token_counts.counter(token_counts.TOKENIZER)
    for _ in range(500):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 14)))
        got = list(accumulate(np.frombuffer(c.steps(text), np.int8).tolist()))
        assert got == library([text[:k] for k in range(1, len(text) + 1)])


def test_token_counts_equal_the_library(spark):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "one"), (3, "one")]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = token_counts.digest(token_counts.prefix_table(clashing(spark, rows)), limit=100)
    want = library([t or "" for _, t in rows])
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, want)), key=str)
    assert token_counts.prefix_table(clashing(spark, rows).where("false")).count() == 0


def test_budgets_are_answered_from_the_table(spark):
    texts = [t for t in ODD if t is None or len(t) < 5000]
    kept = token_counts.prefix_table(clashing(spark, list(enumerate(texts)))).select("doc_id", "text", "steps", "n_tokens")
    at = kept.select("doc_id", *[token_counts.tokens_at(F.col("steps"), k).alias(f"k{k}") for k in (0, 3, 10**6)], *[token_counts.fitting(F.col("steps"), b).alias(f"b{b}") for b in (0, 1, 4)])
    for r in at.collect():
        t = texts[r["doc_id"]] or ""
        of = [0, *library([t[:k] for k in range(1, len(t) + 1)])]
        assert (r["k0"], r["k3"], r["k1000000"]) == (0, of[min(3, len(t))], of[-1])
        assert [r[f"b{b}"] for b in (0, 1, 4)] == [max(k for k, n in enumerate(of) if n <= b) for b in (0, 1, 4)]
    cut = {r["doc_id"]: r for r in token_counts.truncated(kept, 4).collect()}
    for i, r in cut.items():
        assert (r["text"] is None) == (texts[i] is None)
        assert r["n_tokens"] == library([r["text"] or ""])[0] <= 4 and len(r["steps"]) == len(r["text"] or "")
