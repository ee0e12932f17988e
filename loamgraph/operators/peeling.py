"""The order of large graphs without tables of all pairs: peeling, chains, strongly connected parts, and a reachability index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loamgraph.operators import parts as A
from loamgraph.sources.stages import stored

#: Steps along edges that one job takes: the first job's, and the most.
FIRST_STEPS, MOST_STEPS = 4, 16


@dataclass(frozen=True)
class Peeled:
    """``settled(node, depth, l0, l1, ...)``: nodes that no cycle leads to; ``rest(src, dst)``: the edges between all other nodes."""

    settled: DataFrame
    rest: DataFrame


def _highest(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each node: its highest base and labels."""
    return rows.groupBy("node").agg(*[F.max(c).alias(c) for c in ("base", *labels)])


def _walk(e: DataFrame, labels: list[str], steps: int) -> DataFrame:
    """``(node, base, labels, alive)`` of all nodes with an edge in, after so many steps: the best that walks bring to a node, and whether a walk of that many edges ends there.

    Edges carry what both ends have by themselves (``s_base``, ``d_base``, ...), so a step is one join and one sum, and uses the one before once: the plan is a
    line, and the edges, which are read in each step, are exchanged once.
    """
    at = None
    for _ in range(steps):
        rows = e if at is None else e.join(at.hint("shuffle_hash"), F.col("src") == F.col("node"), "left")
        come = lambda c: F.col(f"s_{c}") if at is None else F.coalesce(c, f"s_{c}")
        best = [F.max(F.greatest(come(c) + F.col("w") if c == "base" else come(c), F.col(f"d_{c}"))).alias(c) for c in ("base", *labels)]
        alive = F.lit(True) if at is None else F.coalesce("alive", F.lit(False))
        at = rows.groupBy(F.col("dst").alias("node")).agg(*best, F.max(alive).alias("alive"))
    return at


def _with_ends(e: DataFrame, base: DataFrame, labels: list[str]) -> DataFrame:
    """The edges ``(src, dst, w)`` whose ends both have a base, with the bases and labels of the ends."""
    end = lambda way, to: base.select(F.col("node").alias(way), *[F.col(c).alias(f"{to}_{c}") for c in ("base", *labels)])
    return e.join(end("src", "s"), "src").join(end("dst", "d"), "dst")


def _contracted(e: DataFrame, base: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Edges and bases without the nodes that have one edge in, and those nodes as ``(node, at, w, base, labels)``; None if there is no chain of them.

    A node with one edge in is worth max(base, what its source is worth + w). Such functions compose, so pointers along chains (and trees) of these nodes
    double until they leave them, and the edges out of such a node begin where its pointer ends.
    """
    single = e.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("at"), F.first("w").alias("w")).where("n = 1 and at <> dst").drop("n")
    to = stored(single.join(base, F.col("dst") == F.col("node")).select("node", "at", "w", "base", *labels), "pointers")
    left = to.count()
    if not left or to.alias("a").join(to.alias("b"), F.expr("a.at = b.node")).isEmpty():
        return None
    while left:
        left //= 2
        further = [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in labels]
        joined = to.alias("a").join(to.alias("b"), F.expr("a.at = b.node"), "left")
        w, worth = (F.col("a.w") + F.coalesce("b.w", F.lit(0))).alias("w"), F.greatest("a.base", F.col("b.base") + F.col("a.w")).alias("base")
        to = stored(joined.select("a.node", F.coalesce("b.at", "a.at").alias("at"), w, worth, *further, F.col("b.node").isNotNull().alias("moved")), "pointers")
        moved = not to.where("moved").isEmpty()
        to = to.drop("moved")
        if not moved:
            break
    # Pointers that go round in circles stay as they were.
    to = stored(to.join(to.select(F.col("node").alias("at")), "at", "left_anti"), "contracted")
    away = to.select(F.col("node").alias("src"), "at", F.col("w").alias("more"), F.col("base").alias("brings"), *[F.col(c).alias(f"{c}_") for c in labels])
    kept = e.join(to.select(F.col("node").alias("dst")), "dst", "left_anti").join(away, "src", "left")
    kept = stored(kept.select(F.coalesce("at", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("brings") + F.col("w")).alias("brings"), *[f"{c}_" for c in labels]), "moved-edges")
    brought = kept.where("brings is not null").select(F.col("dst").alias("node"), F.col("brings").alias("base"), *[F.col(f"{c}_").alias(c) for c in labels])
    bases = _highest(base.join(to.select("node"), "node", "left_anti").unionByName(brought), labels)
    return stored(kept.groupBy("src", "dst").agg(F.max("w").alias("w")), "contracted-edges"), stored(bases, "bases"), to


def peel(edges: DataFrame, *, labels: int = 0) -> Peeled:
    """``edges(src, dst)`` -> depths (the longest path to a node) and ``labels`` random labels of all nodes that no cycle leads to, and the other edges.

    A job takes several steps along all edges that are left. A node that no walk of so many edges ends at has its depth, and hands it on; as long as
    some node has none, each step settles one at least, so a job that settles none has only cycles and what is below
    them before it. Where few nodes settle, chains are contracted (``_contracted``), which takes as many joins as the logarithm of the longest
    chain; their nodes get their depths at the end. No number of layers is too large. ``l0``, ``l1``, ... are the highest random numbers
    among a node and all that lead to it. Edges with a null end are ignored, repeated ones count once; a self loop is a cycle.
    """
    names = [f"l{k}" for k in range(labels)]
    whole = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    nodes = whole.select(F.col("src").alias("node")).union(whole.select("dst")).distinct()
    base = stored(nodes.select("node", F.lit(0).cast("long").alias("base"), *[F.xxhash64("node", F.lit(k)).alias(c) for k, c in enumerate(names)]), "bases")
    held_nodes = base.count()
    e, done, pending, steps = whole.withColumn("w", F.lit(1).cast("long")), [], [], FIRST_STEPS
    while True:
        e = _with_ends(e, base, names)
        if done:  # fewer edges than before
            e = stored(e, "edges")
        at = stored(_walk(e, names, steps), "walked")
        settled = at.where("not alive").drop("alive").unionByName(base.join(at.select("node"), "node", "left_anti"))
        alive = at.where("alive").select("node")
        n = {"alive": alive.count()}
        n["settled"] = held_nodes - n["alive"]
        done.append(settled)
        if not n["alive"] or not n["settled"]:
            break
        steps = min(MOST_STEPS, 2 * steps)
        e = e.select("src", "dst", "w")
        brought = e.join(settled, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("base") + F.col("w")).alias("base"), *names)
        base = stored(_highest(base.unionByName(brought).join(alive, "node", "left_semi"), names), "bases")
        held_nodes = n["alive"]
        live = e.join(base.select(F.col("node").alias("src")), "src", "left_semi").join(base.select(F.col("node").alias("dst")), "dst", "left_semi")
        if n["settled"] < n["alive"] and (found := _contracted(stored(live, "edges"), base, names)):
            e, base, held = found
            held_nodes = base.count()
            pending.append(held)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    for held in reversed(pending):  # those contracted last point to what is settled, or to nothing that is
        known = out.select(F.col("node").alias("at"), F.col("base").alias("brings"), *[F.col(c).alias(f"{c}_") for c in names])
        got = held.join(known, "at").select("node", F.greatest("base", F.col("brings") + F.col("w")).alias("base"), *[F.greatest(c, f"{c}_").alias(c) for c in names])
        out = out.unionByName(stored(got, "resolved"))
    out = out.withColumnRenamed("base", "depth")
    if not n["alive"] and not pending:
        return Peeled(out, whole.limit(0))
    out = stored(out, "settled")
    rest = whole.join(out.select(F.col("node").alias("src")), "src", "left_anti").join(out.select(F.col("node").alias("dst")), "dst", "left_anti")
    return Peeled(out, stored(rest.select("src", "dst"), "cyclic-edges"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _spread(e: DataFrame, nodes: DataFrame, *, seed: int, labels: int) -> DataFrame:
    """``(node, up, down)``: arrays of the highest random numbers among a node and all that ``e(src, dst)`` leads to it from, and among it and all it leads to.

    Both ways are walked at once, several steps in a job, until no number changes.
    """
    names = [f"l{k}" for k in range(labels)]
    both = e.select(F.lit(0).alias("way"), "src", "dst").unionByName(_turned(e).withColumn("way", F.lit(1)))
    start = nodes.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    held = stored(both.where("src <> dst").unionByName(start.select("way", F.col("node").alias("src"), F.col("node").alias("dst"))), "spreading-edges")
    at, steps = start.select("way", "node", *[F.xxhash64("node", F.lit(seed + k)).alias(c) for k, c in enumerate(names)]), FIRST_STEPS
    while True:
        for _ in range(steps):
            moved = held.alias("e").join(at.alias("a").hint("shuffle_hash"), F.expr("e.way = a.way and e.src = a.node")).select("e.way", "e.src", "e.dst", *names)
            own = F.max(F.when(F.col("src") == F.col("dst"), F.col(names[0])))
            at = moved.groupBy("way", F.col("dst").alias("node")).agg(*[F.max(c).alias(c) for c in names], own.alias("before"), *[F.max(F.when(F.col("src") == F.col("dst"), F.col(c))).alias(f"{c}_") for c in names[1:]])
        at = stored(at, "spread")
        changed = at.where(" or ".join([f"{names[0]} <> before", *[f"{c} <> {c}_" for c in names[1:]]]))
        if changed.isEmpty():
            break
        at, steps = at.select("way", "node", *names), min(MOST_STEPS, 2 * steps)
    told = at.groupBy("node").agg(*[F.max(F.when(F.col("way") == w, F.col(c))).alias(f"{c}_{w}") for w in (0, 1) for c in names])
    return told.select("node", F.array(*[f"{c}_0" for c in names]).alias("up"), F.array(*[f"{c}_1" for c in names]).alias("down"))


def strong_parts(edges: DataFrame, *, labels: int = 3, part: str | None = None) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, part)``: the nodes on cycles, and the smallest node that lies on cycles with them.

    What no cycle leads to is peeled off; acyclic graphs end there. The rest is coloured forward and backward: nodes of one part share the highest
    random numbers of all that leads to them, and of all they lead to, so edges between other colours go. Where a number is the
    highest both ways, its node leads to the others and back: that part is found. What is left is coloured anew, with other numbers; as a
    rule one or two rounds do. Numbers have 64 bits. Edges with a null end are ignored; a self loop is a part. No edges give no rows.
    Where ``part`` names a column that both ends of an edge share, small parts are worked out whole in tasks (``parts``).
    """
    if part:
        small, large, bundles = A.split(edges, part)
        kind = edges.schema["src"].dataType
        found = A.worked_out(small, part, bundles, A.strong, ["src", "dst"], StructType([StructField("node", kind), StructField("part", kind)]))
        return found if large is None else found.unionByName(strong_parts(large, labels=labels))
    left, found, seed = peel(edges).rest, [], 0
    loops = left.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    while not left.isEmpty():
        nodes = stored(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "nodes")
        told = _spread(left, nodes, seed=seed, labels=labels)
        root = F.coalesce(*[F.when(F.col("up")[k] == F.col("down")[k], F.struct(F.lit(k).alias("k"), F.col("up")[k].alias("label"))) for k in range(labels)])
        told = stored(told.withColumn("root", root), "colours")
        part = told.where("root is not null").join(loops, "node", "left")
        least = part.groupBy("root").agg(F.min("node").alias("part"), F.count("*").alias("n"), F.max("loop").alias("loop")).where("n > 1 or loop")
        found.append(told.join(least, "root").select("node", "part"))
        open_ = told.where("root is null").select("node", F.struct("up", "down").alias("colour"))
        ends = left.join(open_.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(open_.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst")
        left, seed = stored(ends.where("c = d").select("src", "dst"), "edges"), seed + labels
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# Reachability


def index(edges: DataFrame, *, labels: int = 3) -> DataFrame:
    """``edges(src, dst)``, distinct -> the edges with ``s`` and ``d``, what is known of both ends: a reachability index.

    Of a node: its depth, its height (the longest path from it), the highest of ``labels`` random numbers among what leads to it and among what
    it leads to, and its numbers of edges. If x leads to y, depth and labels of what leads there are no higher in x, and height and labels of what it leads to
    are no lower. Nodes with or next to cycles may lack some of it.
    """
    e = stored(edges.select("src", "dst").distinct(), "edges")
    up, down = peel(e, labels=labels).settled, peel(_turned(e), labels=labels).settled
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = ends.groupBy("node").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))
    names = [f"l{k}" for k in range(labels)]
    known = degree.join(up.select("node", "depth", F.array(*names).alias("above")), "node", "left").join(down.select("node", F.col("depth").alias("height"), F.array(*names).alias("below")), "node", "left")
    known = stored(known.select("node", F.struct("depth", "height", "above", "below", "outs", "ins").alias("k")), "labels")
    rows = e.join(known.select(F.col("node").alias("src"), F.col("k").alias("s")), "src").join(known.select(F.col("node").alias("dst"), F.col("k").alias("d")), "dst")
    return stored(rows.select("src", "dst", "s", "d"), "index")


def _maybe(x: Column, y: Column, *, apart: int = 1) -> Column:
    """Whether labels leave it open that the node of ``x`` leads to that of ``y`` (over ``apart`` edges at least, on graphs without cycles)."""
    deep = F.coalesce(y["depth"] - x["depth"] >= apart, F.lit(True)) & F.coalesce(x["height"] - y["height"] >= apart, F.lit(True))
    above = F.coalesce(F.forall(F.arrays_zip(x["above"].alias("p"), y["above"].alias("q")), lambda z: z["p"] <= z["q"]), F.lit(True))
    below = F.coalesce(F.forall(F.arrays_zip(x["below"].alias("p"), y["below"].alias("q")), lambda z: z["p"] >= z["q"]), F.lit(True))
    return deep & above & below


def _led(ix: DataFrame, start: DataFrame) -> DataFrame:
    """``start(src, dst, x, y, kx, ky)``: questions (src, dst), each answered by any of its pairs where x leads to y -> the ``(src, dst)`` that are.

    An open pair goes on from x, or back from y, where fewer edges are; pairs that labels exclude end, and questions that are answered do.
    """
    out = ix.select(F.col("src").alias("x"), F.col("dst").alias("to"), F.col("d").alias("kt"))
    back = ix.select(F.col("dst").alias("y"), F.col("src").alias("of"), F.col("s").alias("ko"))
    key = ["src", "dst", "x", "y"]
    open_, seen, answered = stored(start.dropDuplicates(key), "open"), start.select(key).limit(0), start.select("src", "dst").limit(0)
    while not open_.isEmpty():
        seen = seen.unionByName(open_.select(key))
        ahead = open_.where(F.col("kx.outs") <= F.col("ky.ins")).join(out, "x").select("src", "dst", F.col("to").alias("x"), "y", F.col("kt").alias("kx"), "ky")
        behind = open_.where(F.col("kx.outs") > F.col("ky.ins")).join(back, "y").select("src", "dst", "x", F.col("of").alias("y"), "kx", F.col("ko").alias("ky"))
        next_ = stored(ahead.unionByName(behind).where((F.col("x") == F.col("y")) | _maybe(F.col("kx"), F.col("ky"))), "met")
        hit = next_.where("x = y").select("src", "dst").distinct()
        answered = answered.unionByName(hit)
        open_ = stored(next_.join(answered, ["src", "dst"], "left_anti").dropDuplicates(key).join(seen, key, "left_anti"), "open")
    return answered.distinct()


def reachable(pairs: DataFrame, edges: DataFrame, *, part: str | None = None) -> DataFrame:
    """The distinct ``pairs(src, dst)`` between which a path of one edge or more leads; pairs with nodes that no edge has aren't among them.

    Where ``part`` names a column that both ends of an edge share, pairs are looked up in what small parts lead to (``parts``).
    """
    asked = pairs.select("src", "dst").hint("merge")  # never broadcast: pairs made by an explode are sized by the rows before it
    if part:
        small, large, bundles = A.split(edges, part)
        found = A.worked_out(small, part, bundles, A.reached, ["src", "dst"], A.ends(edges)).join(asked, ["src", "dst"], "left_semi")
        return found if large is None else found.unionByName(reachable(pairs, large))
    ix = index(edges)
    known = ix.select(F.col("src").alias("node"), F.col("s").alias("k")).unionByName(ix.select(F.col("dst").alias("node"), F.col("d").alias("k"))).dropDuplicates(["node"])
    start = asked.distinct().join(known.select(F.col("node").alias("src"), F.col("k").alias("kx")), "src").join(known.select(F.col("node").alias("dst"), F.col("k").alias("ky")).hint("merge"), "dst")
    return _led(ix, start.where(_maybe(F.col("kx"), F.col("ky"))).select("src", "dst", F.col("src").alias("x"), F.col("dst").alias("y"), "kx", "ky"))


def implied(edges: DataFrame) -> DataFrame:
    """The ``(src, dst)`` of an acyclic graph's edges that a path over other edges replaces.

    Only edges whose ends lie two layers or more apart can be; of those, the ends of the other edges of the source
    (or the starts of those into the target, where these are fewer) are asked for.
    """
    ix = index(edges)
    far = stored(ix.where(_maybe(F.col("s"), F.col("d"), apart=2)), "candidates")
    ahead = far.where(F.col("s.outs") <= F.col("d.ins")).alias("f").join(ix.alias("e"), F.expr("f.src = e.src and e.dst <> f.dst"))
    ahead = ahead.select("f.src", "f.dst", F.col("e.dst").alias("x"), F.col("f.dst").alias("y"), F.col("e.d").alias("kx"), F.col("f.d").alias("ky"))
    behind = far.where(F.col("s.outs") > F.col("d.ins")).alias("f").join(ix.alias("e"), F.expr("f.dst = e.dst and e.src <> f.src"))
    behind = behind.select("f.src", "f.dst", F.col("f.src").alias("x"), F.col("e.src").alias("y"), F.col("f.s").alias("kx"), F.col("e.s").alias("ky"))
    return _led(ix, ahead.unionByName(behind).where(_maybe(F.col("kx"), F.col("ky"))))
