"""Graphs without tables of all pairs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import build as B
from loamgraph.operators import graph as G
from loamgraph.operators import parts as A
from loamgraph.operators import peeling as P


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def led(pairs):
    """Brute force: node -> all that one edge or more lead to."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), list(to.get(n, ()))
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += to.get(at, ())
        out[n] = seen
    return out


def graph(seed, n, m, *, back):
    rnd = random.Random(seed)
    name = rnd.sample(range(1000), n)
    pairs = {tuple(sorted((rnd.randrange(n), min(n - 1, rnd.randrange(n))))) for _ in range(m)}
    pairs = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in [tuple(sorted((rnd.randrange(n), rnd.randrange(n)))) for _ in range(back)]}
    return {(name[a], name[b]) for a, b in pairs}


@pytest.mark.parametrize("seed, n, m, back", [(6, 60, 40, 14), (2, 60, 60, 8)])
def test_parts_of_random_graphs(spark, seed, n, m, back):
    pairs = graph(seed, n, m, back=back)
    to = led(pairs)
    want = [(x, min(y for y in to[x] if x in to[y])) for x in sorted(to) if x in to[x]]
    assert rows(P.strong_parts(frame(spark, pairs)), "node", "part") == want and len({p for _, p in want}) > 1


@pytest.mark.parametrize("seed, n, m", [(3, 40, 120), (4, 60, 70)])
def test_reduction_and_depths_of_random_graphs(spark, seed, n, m):
    pairs = graph(seed, n, m, back=0)
    to = led(pairs)
    kept = [(a, b) for a, b in pairs if not any(b in to[c] for a2, c in pairs if a2 == a and c != b)]
    assert rows(G.reduction(frame(spark, pairs)), "src", "dst") == sorted(kept) and len(kept) < len(pairs)
    depth = {x: 0 for x in to}
    for _ in depth:
        for a, b in pairs:
            depth[b] = max(depth[b], depth[a] + 1)
    nodes = spark.createDataFrame([(x,) for x in [*depth, 5000]], "node long")
    assert rows(G.depths(nodes, frame(spark, pairs)), "node", "depth") == sorted([*depth.items(), (5000, 0)])


def test_reachable_pairs(spark):
    pairs = graph(5, 50, 70, back=3)
    to = led(pairs)
    ask = [(a, b) for a in to for b in to if (a + b) % 7 == 0] + [(-1, -2)]
    assert rows(P.reachable(frame(spark, ask), frame(spark, pairs)), "src", "dst") == sorted((a, b) for a, b in ask if b in to.get(a, ()))


@pytest.mark.parametrize("part", ["p", None])
def test_asked_pairs_are_not_broadcast(spark, part):
    e = spark.range(1_000).where("id % 10 < 9").selectExpr("id as src", "id + 1 as dst", "id div 10 as p")
    ask = spark.range(1_000).selectExpr("id as src", "explode(sequence(1, 800)) as k").selectExpr("src", "src + k as dst")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "20m")  # a table of a few rows may take 16.5 MB
    try:
        got = rows(P.reachable(ask, e, part=part), "src", "dst")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == [(a, b) for a in range(1_000) for b in range(a + 1, a // 10 * 10 + 10)]


def test_a_long_chain_with_branches_and_a_cycle(spark):
    n = 20_000
    place = list(range(n))
    random.Random(6).shuffle(place)
    chain = [(place[i], place[i + 1]) for i in range(n - 1)]
    branch = [(place[10 * i], n + i) for i in range(50)] + [(n + 100 + i, place[100 * i + 7]) for i in range(50)]
    nodes = spark.range(n + 200).withColumnRenamed("id", "node")
    got = dict(rows(G.depths(nodes, frame(spark, chain + branch)), "node", "depth"))
    assert all(got[place[i]] == i for i in range(n)) and all(got[n + i] == 10 * i + 1 for i in range(50)) and got[n + 120] == 0 and len(got) == n + 200
    closed = frame(spark, [*chain, (place[n - 1], place[n - 40])])
    assert rows(P.strong_parts(closed), "node") == sorted((x,) for x in place[n - 40 :])


def test_empty_and_odd_graphs(spark):
    none = frame(spark, [])
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert rows(G.depths(nodes, none), "node", "depth") == [(1, 0), (2, 0)]
    assert P.strong_parts(none).count() == 0 and G.reduction(none).count() == 0 and G.break_cycles(none.selectExpr("*", "1.0 as confidence")).count() == 0
    odd = spark.createDataFrame([(1, 2), (1, 2), (None, 1), (2, None), (3, 3)], "src long, dst long")
    assert rows(P.strong_parts(odd), "node", "part") == [(3, 3)]
    assert rows(G.depths(spark.createDataFrame([(1,), (2,), (3,)], "node long"), odd), "node", "depth") == [(1, 0), (2, 1), (3, 2)]


def _led(pairs):
    found = set(pairs)
    while more := {(a, d) for a, b in found for c, d in pairs if b == c} - found:
        found |= more
    return found


def test_small_parts_in_tasks_are_worked_out_right(spark, monkeypatch):
    monkeypatch.setattr(A, "BUNDLE_EDGES", 30)
    dice = random.Random(12)
    found = [(10 * p + dice.randrange(8), 10 * p + dice.randrange(8), dice.choice([None, 0.25, 0.5, float("nan"), 1.0]), p) for p in range(12) for _ in range(dice.choice([3, 9, 20]))]
    e = spark.createDataFrame([*found, (None, 3, 1.0, 0), (31, None, 1.0, 3)], "src long, dst long, confidence double, p int")
    pairs = {r[:2] for r in found}
    led = _led(pairs)
    assert rows(P.strong_parts(e, part="p"), "node", "part") == sorted((a, min(c for c, d in led if (a, c) in led and (c, a) in led)) for a, b in led if a == b)
    assert rows(G.relatives(e.selectExpr("src as node").where("node % 3 = 0"), e, down=False, part="p"), "node", "other") == sorted((b, a) for a, b in led if b % 3 == 0 and b in {x[0] for x in pairs})
    rank = {}
    for a, b, c, _ in found:
        key = (c is not None, c != c, c if c is not None and c == c else 0, a, b)
        rank[a, b] = min(key, rank.get((a, b), key))
    gone = {(a, b) for a, b in pairs if a == b or (b, a) in _led({x for x in pairs if rank[x] > rank[a, b]})}
    assert rows(G.break_cycles(e.where("src is not null and dst is not null"), part="p"), "src", "dst") == sorted(r[:2] for r in found if r[:2] not in gone) != []
    kept = pairs - gone
    implied = {(a, b) for a, b in kept if any(c == a and d != b and (d, b) in _led(kept) for c, d in kept)}
    assert implied and gone and {tuple(r) for r in B.judged_edges(e.dropna(subset=["src", "dst"]), part="p").collect()} == {(*x, "cycle" if x in gone else "implied" if x in implied else "kept") for x in pairs}
    acyclic = spark.createDataFrame([(a, b, a // 10) for a, b in kept], "src long, dst long, p int")
    assert rows(G.reduction(acyclic, part="p"), "src", "dst") == sorted(kept - implied)
    assert rows(P.reachable(e.selectExpr("src", "src + 1 + dst % 4 as dst"), e, part="p"), "src", "dst") == sorted({(a, a + 1 + b % 4) for a, b in pairs} & led)
    monkeypatch.setattr(A, "PART_EDGES", 8)  # the larger parts go another way, and edges without a part
    assert rows(G.closure(e.dropna(subset=["src", "dst"]).withColumn("p", F.expr("nullif(p, 5)")), part="p"), "src", "dst") == sorted(led)


def test_many_small_parts_take_few_jobs(spark):
    e = spark.range(0, 30_000, 1, 4).selectExpr("id as src", "id div 10 * 10 + (id + 1) % 10 as dst", "cast(hash(id) as double) as confidence", "id div 10 as p")
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    assert G.break_cycles(e, part="p").count() == 27_000
    assert max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 8  # each doubling of the paths stored all pairs before
