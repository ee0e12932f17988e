"""Operators 1, 5, 6, 7, 8 and the pipeline against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loamgraph.llm import decontamination, line_dedup, mixing, sharding, simhash_dedup
from loamgraph.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


# Line dedup


def brute_lines(rows, min_words=5):
    signed = lambda t: (lambda h: h - (1 << 64) if h >= 1 << 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    lines = sorted(((i if i is not None else line_dedup.NO_ID, signed(t), row, k), tuple(x.split())) for row, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x.split())
    out, first = Counter(), {}
    for at, w in lines:
        first.setdefault(w, at)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))

    gone = {w for w in first if any(first[v] < first[w] and max(len(v), len(w)) >= min_words and near(v, w) for v in first)}
    for at, w in lines:
        out[at[0] if at[0] != line_dedup.NO_ID else None, "near" if w in gone else "kept" if first[w] == at else "copy"] += 1
    return out


def test_line_status_equals_brute_force(spark):
    rng = random.Random(5)
    bases = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(12)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.choice([0, 1])] = [] if rng.random() < 0.4 else [rng.choice("abcxyz")]
        return "  ".join(w)

    rows = [(i, "\n".join(line() for _ in range(6))) for i in range(40)] + [(100, None), (101, ""), (102, " \n\n"), (None, "null id line with five words"), (None, "null id line with six more words\nnull id line with five words"), (7, "another text\nof one two three four five"), (7, "another text\nof one two three four five"), (103, "word " * 20000), (104, "word " * 20001)]
    got = Counter((r["doc_id"], r["status"]) for r in line_dedup.line_status(docs_of(spark, rows)).collect())
    assert got == brute_lines(rows)


def test_lines_are_taken_out_of_texts(spark):
    rows = [(1, "one two three four five\n\nshort"), (2, "one two three four six\nshort\nown line"), (3, None)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "own line", 3: None}
    alike = [(None, "same line here\nfirst own words"), (None, "same line here\nsecond text of its own"), (None, "same line here\nthird"), (5, "x1 x2 x3 x4 x5 x6"), (5, "a b c d e f"), (1, "a b c d e f"), (9, "x1 x2 x3 x4 x5 x6"), (9, "x1 x2 x3 x4 x5 x6")]
    clash = docs_of(spark, alike).withColumn("line_no", F.lit(1)).withColumn("rid", F.lit("own")).withColumn("at", F.lit(2))
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns
    left = Counter((r["doc_id"], line) for r in out.collect() for line in (r["text"] or "").split("\n") if line)
    assert left == {(None, "same line here"): 1, (None, "first own words"): 1, (None, "second text of its own"): 1, (None, "third"): 1, (5, "x1 x2 x3 x4 x5 x6"): 1, (1, "a b c d e f"): 1}
    assert line_dedup.document_lines(docs_of(spark, rows).limit(0)).count() == 0


# Decontamination


def brute_similarity(a, b):
    bags = [Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b)]
    weight = lambda bag: sum(n * (1 + math.log(len("".join(set(x.split()))))) for x, n in bag.items())
    return weight(bags[0] & bags[1]) / weight(bags[0] | bags[1])


def test_the_radius_loses_no_window_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found, exact = ({(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench, radius=r).collect()} for r in (23, 64))
    assert found <= exact and len(found) >= 0.99 * len(exact) > 0


def test_windows_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 20)))) for k in range(12)] + [(50, "only three words"), (51, None), (52, ""), (53, "Only THREE words!")]
    texts = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        copy = rng.choice(items[:12])[1].split()
        if rng.random() < 0.5 and i % 2:
            copy[rng.randrange(len(copy))] = "edit"
        at = rng.randrange(len(body) + 1)
        texts.append((i, " ".join(body[:at] + (copy if i % 3 else []) + body[at:])))
    texts += [(90, "say only, three WORDS here"), (91, None), (92, "")]
    want = set()
    for i, t in texts:
        w = decontamination.folded_words(t)
        for k, item in items:
            v = decontamination.folded_words(item)
            if not v:
                continue
            if len(v) < 5:
                hit = any(w[s : s + len(v)] == v for s in range(len(w)))
            else:
                size = min(len(v), len(w))
                hit = size >= 5 and any(brute_similarity(w[s : s + size], v) >= 0.8 for s in range(len(w) - size + 1))
            if hit:
                want.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench).collect()}
    assert got == want and (90, 50) in got and (90, 53) in got
    for blocks in (1, 3):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench, block_items=blocks).collect()} == want
    clash = docs.withColumn("item_id", F.lit(1)).withColumn("similarity", F.lit("own"))
    assert decontamination.decontaminate(clash.unionByName(clash), bench).columns == clash.columns
    assert decontamination.decontaminate(clash.unionByName(clash), bench).count() == 2 * (len(texts) - len({i for i, _ in want}))
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in want}
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


# SimHash


def brute_fingerprint(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        rows.append((1000 - i, " ".join(w)))
    rows += [(1, ""), (2, None), (3, " \n"), (4, "two words"), (5, "TWO words"), (5, "TWO words"), (None, "two words"), (7, "É a\x0bb" * 30000)]
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = sorted((str(d), p, least[root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))
    got = simhash_dedup.simhash_components(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = [r["doc_id"] for r in simhash_dedup.dedup(docs_of(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for *_, c in want}) and None not in kept


def test_dedup_judges_rows_by_their_own_texts(spark):
    own = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "a b c d e f"), (5, "x1 x2 x3 x4 x5 x6"), (5, "a b c d e f"), (None, own), (None, own), (None, "another text without an id"), (6, ""), (7, None)]
    docs = docs_of(spark, rows).withColumn("fp", F.lit("own")).withColumn("component", F.lit(1)).withColumn("rid", F.lit(2))
    out = simhash_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, "a b c d e f"), (5, "x1 x2 x3 x4 x5 x6"), (None, own), (None, "another text without an id"), (6, "")])
    assert simhash_dedup.dedup(docs.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for center in (0, rng.getrandbits(64)):
        prints |= {center ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(400)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    for chunk in (16, 1024):
        links = simhash_dedup.near_pairs(spark.createDataFrame(signed, "fp long"), chunk=chunk).collect()
        parent = {p: p for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            u, v = u % (1 << 64), v % (1 << 64)
            assert (u ^ v).bit_count() <= 4
            parent[root(u)] = root(v)
        assert all(root(a) == root(b) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= 4)
    assert simhash_dedup.simhash_components(docs_of(spark, []).limit(0)).count() == 0


def test_copies_for_masks_are_not_broadcast(spark):
    fps = spark.range(5_000).selectExpr("explode(array(xxhash64(id), xxhash64(id) ^ 1)) as fp").distinct()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        links = simhash_dedup.near_pairs(fps).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(links) == 5_000 and {u ^ v for u, v in links} == {1}


def test_the_pipelines_dedup_broadcasts_no_copies_for_masks(spark):
    docs = spark.range(40_000, numPartitions=4).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 7), k -> xxhash64(id div 2, k))) as text")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "20m")  # a table of a few rows may take 16.5 MB
    try:
        kept = sorted(r[0] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").select("doc_id").collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert kept == list(range(0, 40_000, 2))


# Mixing


def test_rows_without_ids_keep_to_budgets(spark):
    docs = spark.createDataFrame([(None, f"one two {i}", "en", "a", 0) for i in range(1000)] + [(7, f"three {i}", "en", "b", 0) for i in range(500)], DOCS)
    mix = mixing.mixture(docs, repetition=None, entropy=0.5, budget=6000)
    blocks = {s: len({r["block"] for r in mixing.permuted(mix).where(f"source = '{s}'").collect()}) for s in "ab"}
    assert blocks["a"] > 20 and blocks["b"] > 15  # not one block for all rows of one id or none
    want = {r["source"]: r["budget"] for r in mix.sources.collect()}
    got = Counter()
    for r in mixing.mix_documents(docs, repetition=None, entropy=0.5, budget=6000).collect():
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 3 for s in want) and sum(want.values()) == pytest.approx(6000, abs=2)


def test_budgets_far_above_a_source(spark):
    docs = spark.createDataFrame([(1, "one", "en", "tiny", 0), (2, "w " * 50, "en", "large", 0)], DOCS)
    mix = mixing.mixture(docs, repetition=None, entropy=0.999, budget=10**11)
    assert mix.sources.agg(F.sum("budget")).first()[0] == pytest.approx(10**11, abs=2)
    wide = mixing._repeated(spark.createDataFrame([(1, 70_000), (2, 0), (3, 1)], "id long, n long"), F.col("n"), "pass")
    assert [tuple(r) for r in wide.groupBy("id").agg(F.count("*"), F.min("pass"), F.max("pass"), F.count_distinct("pass")).orderBy("id").collect()] == [(1, 70_000, 0, 69_999, 70_000), (3, 1, 0, 0, 1)]


def test_mixture_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i < 160 else "mid" if i < 190 else None, 0) for i in range(200)]
    docs = spark.createDataFrame([*rows, (0, "w", "en", "big", 0), (0, "w", "en", "big", 0), (None, None, "en", "big", 0)], DOCS)
    mix = mixing.mixture(docs, repetition=2.0)
    src = {r["source"]: r for r in mix.sources.collect()}
    epochs = {s: r["budget"] / r["tokens"] for s, r in src.items()}
    assert min(epochs.values()) == pytest.approx(1, abs=0.01) and max(epochs.values()) == pytest.approx(2, abs=0.05)
    assert sum(r["weight"] for r in src.values()) == pytest.approx(1)
    stream = mixing.permuted(mix).collect()
    seen = Counter((r["doc_id"], r["source"]) for r in stream)
    assert set(seen) == {(r["doc_id"], r["source"] or "") for r in docs.collect()}
    for s, r in src.items():
        own = sorted((x["position"], x["n_tokens"]) for x in stream if x["source"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] < r["budget"] <= sum(own[-1])
    mixed = Counter((r["doc_id"], r["source"] or "") for r in mixing.mix_documents(docs, repetition=2.0).collect())
    assert sum(mixed.values()) == pytest.approx(len(stream), abs=3) and all(mixed[k] >= 1 for k in seen)
    clash = docs.where("doc_id > 3").withColumn("pass", F.lit("own")).withColumn("block", F.lit(1))
    out = mixing.mix_documents(clash, repetition=2.0)
    assert out.columns == clash.columns
    order = [r["doc_id"] for r in out.collect()]
    apart = [b - a for d in set(order) if order.count(d) == 2 for a, b in [[k for k, x in enumerate(order) if x == d]]]
    assert apart and sum(apart) / len(apart) > len(order) / 8  # copies are a pass apart
    flat = mixing.mixture(docs, repetition=None, entropy=0.9)
    p = [r["weight"] for r in flat.sources.collect()]
    assert -sum(x * math.log(x) for x in p) / math.log(3) == pytest.approx(0.9, abs=1e-4)
    half = mixing.permuted(mixing.mixture(docs, budget=100)).agg(F.sum("n_tokens")).first()[0]
    assert 100 <= half <= 125
    assert mixing.permuted(mixing.mixture(docs.limit(0))).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


# Sharding


def brute_place(key, shards):
    name = "null" if key is None else str(key)
    uniform = lambda *parts: (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def draw(k, level, weights):
        return min((-math.log(uniform(*k, f"{level}{i}")) / w, i) for i, w in weights.items())[1]

    for attempt in range(sharding.TRIES):
        k, left = (name, str(attempt)), shards
        for level in ("region", "rack"):
            of = Counter()
            for s in left:
                of[getattr(s, level)] += s.capacity
            at = draw(k, level, of)
            left = [s for s in left if getattr(s, level) == at]
        at = draw(k, "shard", {s.number: s.capacity for s in left})
        s = next(s for s in left if s.number == at)
        if uniform(*k, f"take{at}") < s.weight / s.capacity:
            return s.region, s.rack, s.number
    at = draw((name,), "all", {s.number: s.weight for s in shards if s.weight > 0})
    return next((s.region, s.rack, s.number) for s in shards if s.number == at)


def test_shards_hold_the_key_law(spark):
    rows = [(i, "é" * (i % 50)) for i in range(3000)] + [(None, None), (None, ""), (7, "again")]
    docs = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    out = sharding.shard_documents(docs, buckets=8).collect()
    assert len(out) == len(rows)
    for r in out[:300]:
        assert (r["region"], r["rack"], r["shard"]) == brute_place(r["doc_id"], sharding.tree(24)) and r["grown_shard"] == brute_place(r["doc_id"], sharding.tree(25))[2]
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert moved and all(r["grown_shard"] == 24 for r in moved) and 60 < len(moved) < 190
    for s in range(24):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own))) and 70 < len(own) < 190
    for r in out:
        if r["doc_id"] not in (None, 7):
            text = dict(rows)[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    assert {r["rack"] for r in out} == set(range(6)) and all(r["shard"] // 4 == r["rack"] and r["rack"] // 3 == r["region"] for r in out)
    again = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs).collect()}
    assert all(again[r["doc_id"]] == r["shard"] for r in out)


def test_weights_move_rows_in_their_subtree_only(spark):
    docs = docs_of(spark, [(i, "") for i in range(4000)])
    before = [replace(s, capacity=3.0) for s in sharding.tree(6, per_rack=2, racks_per_region=2)]
    after = [replace(s, weight=3.0) if s.number == 2 else s for s in before]
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(docs, t).collect()} for t in (before, after))
    assert all(b[i] in (a[i], 2) for i in a) and Counter(b.values())[2] == pytest.approx(4000 * 3 / 8, rel=0.12)
    wider = [replace(s, capacity=6.0) if s.number == 2 else s for s in before]
    c = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, wider).collect()}
    assert Counter(c.values())[2] == pytest.approx(4000 / 6, rel=0.15)
    with pytest.raises(ValueError):
        sharding.place("doc_id", [sharding.Shard(0, 0, 0, weight=0.0)])


def test_sharding_leaves_other_columns_alone(spark):
    docs = docs_of(spark, [(i, "t") for i in range(50)] + [(None, None)] * 3)
    for name in ("bucket", "k", "offset", "n", "slot"):
        docs = docs.withColumn(name, F.lit("own"))
    out = sharding.assign(docs, sharding.tree(6), carry=True)
    rows = out.collect()
    assert len(rows) == 53 and set(docs.columns) <= set(out.columns) and all(r["bucket"] == r["k"] == r["offset"] == r["n"] == "own" for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.assign(docs.limit(0), sharding.tree(6)).count() == 0


# Pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    from loamgraph.llm import toxicity
    from loamgraph.llm.common import table

    scores = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
    left = {r["doc_id"] for r in scores if r["score"] < 0.7}
    prints = {i: brute_fingerprint(docs[i]["text"]) for i in left}
    near = {i: {j for j in left if (prints[i] ^ prints[j]).bit_count() <= 4} for i in left}
    stay, todo = set(), set(left)
    while todo:
        part, queue = set(), [min(todo)]
        while queue:
            x = queue.pop()
            if x not in part:
                part.add(x)
                queue += near[x] - part
        stay.add(min(part))
        todo -= part
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontamination.Index(items, radius=23, similarity=0.8)
    stay = {i for i in stay if not index.find(docs[i]["text"])}
    assert {r["doc_id"] for r in out} == stay
    assert all(r["text"] == docs[r["doc_id"]]["text"] for r in out)
    times = Counter(r["doc_id"] for r in out)
    assert set(times.values()) <= {1, 2}
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, sf_dir).columns) == sorted(docs.columns), name
