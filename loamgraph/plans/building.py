"""Queries of the planner: nodes and prerequisites built from units, their checks, and cut plans with their repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import graph as G
from loamgraph.operators import lines as L
from loamgraph.operators import nodes as N
from loamgraph.operators import repair as R
from loamgraph.plans.registry import query
from loamgraph.sources.stages import stored, table


def text_of(c: str):
    return F.col(c).cast("string")


# Nodes


@query("""WITH f AS (SELECT l_partkey AS unit, min(l_orderkey) AS node_ord FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT node_ord, 'kn:' || substr(sha1(string_agg(unit::VARCHAR, '|' ORDER BY unit::VARCHAR)), 1, 16) AS node, string_agg(unit::VARCHAR, ',' ORDER BY unit::VARCHAR) AS members,
  array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS collections, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS title FROM f JOIN part ON p_partkey = unit GROUP BY node_ord""")
def canonical_nodes(spark, sf):
    units = table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("collection"), F.col("p_name").alias("title"))
    members, _ = N.first_claims(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node_ord"), F.col("l_partkey").alias("unit")), units)
    return N.node_ids(members, units).withColumn("members", F.array_join("members", ",")).withColumn("collections", F.array_join("collections", ","))


@query("SELECT p_type AS define, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS defined_by FROM part GROUP BY p_type")
def define_dictionary(spark, sf):
    rows = N.define_dictionary(table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("define")))
    return rows.withColumn("defined_by", F.array_join("defined_by", ","))


@query("SELECT l_orderkey AS unit, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS defines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def allowed_defines(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("p_partkey = l_partkey")).select(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("define"))
    return N.allowed_defines(rows).withColumn("defines", F.array_join("defines", ","))


@query("""WITH n AS (SELECT lower(n_name) AS k, max(n_nationkey) AS by_title FROM nation GROUP BY 1)
SELECT s_suppkey AS ord, coalesce(CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey::VARCHAR END, by_title::VARCHAR) AS target FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN n ON k = CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE lower(n_name) END""")
def resolved_nodes(spark, sf):
    nation = table(spark, sf, "nation")
    items = table(spark, sf, "supplier").join(nation, F.expr("n_nationkey = s_nationkey")).select(
        F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 2 == 1, text_of("s_nationkey")).otherwise("").alias("node"), F.when(F.col("s_suppkey") % 5 == 0, "nowhere").otherwise(F.lower("n_name")).alias("title_key")
    )
    nodes = nation.select(text_of("n_nationkey").alias("node"), F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("title_key"))
    return N.resolved(items, nodes).select("ord", "target")


@query("SELECT c_custkey AS node, coalesce(arg_max(o_orderpriority, o_orderkey), '') AS external FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def external_prerequisites(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("node"), F.array("o_orderpriority").alias("external"))
    return N.attached(table(spark, sf, "customer").select(F.col("c_custkey").alias("node")), items, "external").withColumn("external", F.array_join("external", ","))


@query("""SELECT c_custkey AS node, c_mktsegment AS title FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier""")
def replaced_nodes(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("node"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("node"), F.col("s_name").alias("title"))
    return N.replaced(table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("title")), gone, new)


@query("""WITH h AS (SELECT lower(p_name) AS define, min(p_partkey) AS holder FROM part GROUP BY 1)
SELECT holder AS a, p_partkey AS b, 'duplicate_define' AS kind, define FROM part JOIN h ON lower(p_name) = define WHERE p_partkey <> holder ORDER BY holder, p_partkey, define LIMIT 1""")
def first_define_conflict(spark, sf):
    found = N.duplicate_defines(table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.lower("p_name").alias("key")))
    rows = found.select(F.array("holder", "node").alias("orders"), F.array("holder", "node").alias("nodes"), F.lit("duplicate_define").alias("kind"), F.col("key").alias("define"))
    return N.first_conflict(rows).select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), "kind", "define")


@query("SELECT count(*) AS units, count(*) FILTER (o IS NULL) AS unassigned, count(*) FILTER (o IS NULL) / count(*) AS share, count(*) FILTER (o IS NULL) / count(*) > 0.1 AS warning FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def unassigned_share(spark, sf):
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))
    _, free = N.first_claims(table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_ord"), F.col("o_custkey").alias("unit")), units)
    return N.unassigned_share(units, free)


@query("WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1) SELECT count(*) AS nodes, count(*) FILTER (n = 0) AS roots, count(*) > 1 AND (count(*) FILTER (n = 0) = count(*) OR (count(*) >= 5 AND count(*) FILTER (n = 0) / count(*) >= 0.8)) AS suspicious FROM r")
def root_review(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("required"))
    return N.root_review(rows)


_ITEMS = """it AS (SELECT o_orderkey AS ord, o_custkey AS node, CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'none' END AS decision, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE 'why' END AS reason FROM orders),
rq AS (SELECT l_orderkey AS ord, list(DISTINCT l_partkey % 60) AS required FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1),
df AS (SELECT p_partkey % 50 AS key, count(DISTINCT p_partkey % 500) AS n, min(p_partkey % 500) AS source FROM part WHERE p_partkey % 50 > 10 OR p_partkey < 50 GROUP BY 1)"""


def _items(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = table(spark, sf, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("ord")).agg(F.collect_set(F.col("l_partkey") % 60).alias("required"))
    decision = F.when(F.col("o_orderstatus") == "F", "selected").when(F.col("o_orderstatus") == "O", "none")
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("node"), decision.alias("decision"), F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise("why").alias("reason"))
    items = items.join(keys, "ord", "left").withColumn("required", F.coalesce("required", F.array().cast(keys.schema["required"].dataType)))
    nodes = table(spark, sf, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("node"))
    defines = table(spark, sf, "part").where("p_partkey % 50 > 10 or p_partkey < 50").select((F.col("p_partkey") % 50).alias("key"), (F.col("p_partkey") % 500).alias("node"))
    return items, nodes, defines


@query(f"""WITH {_ITEMS}, i AS (SELECT it.*, coalesce(required, []) AS required, len(coalesce(required, [])) AS n, min(ord) OVER (PARTITION BY node) AS first FROM it LEFT JOIN rq USING (ord)),
m AS (SELECT ord, bool_or(df.n IS NULL) AS strange, bool_or(df.n = 1 AND source = node) AS own FROM (SELECT ord, node, unnest(required) AS key FROM i) LEFT JOIN df USING (key) GROUP BY ord)
SELECT ord, node, CASE WHEN node % 7 = 0 THEN 'unknown_node' WHEN ord > first THEN 'duplicate_node' WHEN decision = 'selected' AND n = 0 THEN 'selected_without_defines' WHEN decision = 'none' AND n > 0 THEN 'none_with_defines'
  WHEN decision IS NULL THEN 'no_decision' WHEN n > 24 THEN 'too_many' WHEN n = 0 AND trim(reason) = '' THEN 'no_reason' WHEN strange THEN 'unknown_define' WHEN own THEN 'own_define' END AS problem FROM i LEFT JOIN m USING (ord)""")
def prerequisite_problems(spark, sf):
    return N.prerequisite_problems(*_items(spark, sf))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey % 7 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_nodes(spark, sf):
    return N.uncovered_nodes(*_items(spark, sf)[:2])


@query("""WITH p AS (SELECT l_orderkey AS ord, list(DISTINCT l_partkey) AS members, list(DISTINCT l_suppkey % 30) AS defines FROM lineitem GROUP BY 1),
u AS (SELECT ord, unnest(members) AS unit FROM p), f AS (SELECT unit, min(ord) AS first FROM u GROUP BY 1),
m AS (SELECT ord, bool_or(unit % 13 = 0) AS outside, bool_or(first < ord) AS repeated FROM u JOIN f USING (unit) GROUP BY 1),
v AS (SELECT DISTINCT d.ord FROM (SELECT ord, unnest(defines) AS define FROM p) d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.ord = d.ord AND u.unit % 30 = d.define))
SELECT ord, CASE WHEN ord % 11 = 0 THEN 'no_title' WHEN len(defines) > 8 THEN 'too_many_defines' WHEN outside THEN 'outside' WHEN repeated THEN 'repeated' WHEN v.ord IS NOT NULL THEN 'invented_define' END AS problem FROM p JOIN m USING (ord) LEFT JOIN v USING (ord)""")
def replacement_problems(spark, sf):
    line = table(spark, sf, "lineitem")
    title = F.when(F.col("l_orderkey") % 11 == 0, " ").otherwise("t")
    nodes = line.groupBy(F.col("l_orderkey").alias("ord"), title.alias("title")).agg(F.collect_set("l_partkey").alias("members"), F.collect_set(F.col("l_suppkey") % 30).alias("defines"))
    parts = line.select(F.col("l_partkey").alias("unit")).distinct()
    return N.replacement_problems(nodes, parts.where("unit % 13 > 0"), parts.select("unit", (F.col("unit") % 30).alias("define")))


@query("SELECT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 2 = 0)")
def omitted_members(spark, sf):
    nodes = table(spark, sf, "lineitem").where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("members"))
    return N.omitted_members(nodes, table(spark, sf, "part").select(F.col("p_partkey").alias("unit")))


@query("""WITH c AS (SELECT c_custkey AS node, [c_custkey % 4, 10 + c_custkey % 5] AS r1,
    CASE WHEN c_custkey % 3 = 0 THEN [10 + c_custkey % 5] WHEN c_custkey % 17 = 0 THEN [c_custkey % 4, 10 + c_custkey % 5, 99] ELSE [c_custkey % 4, 10 + c_custkey % 5] END AS r2 FROM customer),
f AS (SELECT n.node, list(DISTINCT d.node % 4) AS free FROM c n JOIN c d ON d.node = n.node - 1 WHERE n.node % 2 = 0 GROUP BY 1)
SELECT node, CASE WHEN node % 11 = 0 THEN 'external_changed' WHEN node % 2 = 1 AND r1 <> r2 THEN 'changed_off_cycle' WHEN node % 2 = 1 AND node % 13 = 0 THEN 'decision_changed'
  WHEN node % 2 = 1 THEN NULL WHEN list_contains(r2, 99) THEN 'added' WHEN len(list_filter(r1, lambda x: NOT list_contains(r2, x) AND NOT list_contains(coalesce(free, []), x))) > 0 THEN 'removed_off_cycle' END AS problem FROM c LEFT JOIN f USING (node)""")
def cycle_repair_problems(spark, sf):
    k = F.col("c_custkey")
    own, other = (k % 4).cast("string"), (10 + k % 5).cast("string")
    rows = table(spark, sf, "customer")
    before = rows.select(k.alias("node"), F.array(own, other).alias("required"), F.array(F.lit("e")).alias("external"), F.lit("selected").alias("decision"))
    after = rows.select(
        k.alias("node"), F.when(k % 3 == 0, F.array(other)).when(k % 17 == 0, F.array(own, other, F.lit("99"))).otherwise(F.array(own, other)).alias("required"),
        F.when(k % 11 == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit("e"))).alias("external"), F.when(k % 13 == 0, "none").otherwise("selected").alias("decision"),
    )
    cycle = rows.where("c_custkey % 2 = 0 and c_custkey > 1").select((k - 1).alias("src"), k.alias("dst"))
    return N.cycle_repair_problems(before, after, cycle, rows.select(own.alias("key"), k.alias("node")))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS own FROM events),
t AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(own IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), event_id) AS target
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT user_id AS collection, target, string_agg(event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR) AS members, min(ts) AS ord, count(*) AS n, bool_or(own IS NOT NULL) AS d FROM t GROUP BY 1, 2)
SELECT collection, ord, CASE WHEN n > 1 THEN 'kn:' || substr(sha1(members), 1, 16) ELSE target::VARCHAR END AS node, members, CASE WHEN d THEN 1 ELSE 0 END AS n_defines FROM m""")
def merged_without_defines(spark, sf):
    own = F.when(F.col("event_type") == "purchase", F.array(F.lit("d"))).otherwise(F.array().cast("array<string>"))
    nodes = table(spark, sf, "events").select(F.col("user_id").alias("collection"), F.col("ts").alias("ord"), text_of("event_id").alias("node"), F.array(text_of("event_id")).alias("members"), own.alias("defines"))
    rows = N.merged_without_defines(nodes)
    return rows.select("collection", "ord", "node", F.array_join("members", "|").alias("members"), F.coalesce(F.size("defines"), F.lit(0)).alias("n_defines"))


@query("""SELECT n_regionkey AS cluster, count(*) = 1 AS single, string_agg(n_name, ',' ORDER BY n_nationkey) AS titles FROM nation GROUP BY 1""")
def cluster_payload(spark, sf):
    nation = table(spark, sf, "nation")
    units = nation.select(F.col("n_nationkey").alias("unit"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.array("n_name").alias("defines"))
    rows = N.cluster_payload(nation.select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("unit")), units)
    return rows.select("cluster", "single", F.array_join(F.transform("units", lambda u: u["title"]), ",").alias("titles"))


# Cut plans: an order is a source, its lines are units of three lines and a share more, one after the other with gaps and overlaps

_PLAN = """raw AS (SELECT l_orderkey AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS idx, * FROM lineitem),
plan AS (SELECT source_id, idx, CASE WHEN l_partkey % 31 = 0 THEN 'x' ELSE (3 * idx - 2 - l_suppkey % 7 // 6)::VARCHAR END AS start_line, (3 * idx - l_suppkey % 5 // 4)::VARCHAR AS end_line,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE p_name END AS title, CASE WHEN l_partkey % 9 = 0 THEN ['a1', 'b2', 'c3', 'd4', 'e5'] WHEN l_partkey % 5 = 0 THEN [] ELSE [p_brand, lower(p_brand), 'w' || l_suppkey % 20] END AS defines,
  CASE l_returnflag WHEN 'A' THEN 'Excercise' WHEN 'R' THEN 'odd' ELSE 'concept' END AS unit_kind FROM raw JOIN part ON p_partkey = l_partkey),
n AS (SELECT source_id, (3 * max(idx))::INTEGER AS line_count FROM raw GROUP BY 1),
cast_ AS (SELECT source_id, idx, try_cast(start_line AS INTEGER) AS s, try_cast(end_line AS INTEGER) AS e, line_count, defines, title, unit_kind FROM plan JOIN n USING (source_id)),
part_ AS (SELECT *, CASE WHEN s IS NULL THEN 'start_line' WHEN len(defines) = 5 THEN 'defines' WHEN s < 1 OR e > line_count THEN 'out_of_bounds' WHEN e < s THEN 'inverted' END AS problem,
  coalesce(nullif(trim(title), ''), '教学单元 ' || idx) AS name, CASE lower(unit_kind) WHEN 'excercise' THEN 'exercise' ELSE 'concept' END AS kind,
  CASE WHEN len(defines) = 5 AND s IS NULL THEN defines WHEN len(defines) = 3 THEN [defines[1], defines[3]] ELSE [] END AS own FROM cast_),
done AS (SELECT *, coalesce(problem IS NULL OR (problem = 'defines' AND s >= 1 AND e <= line_count AND s <= e), false) AS valid FROM part_)"""


def _plan(spark, sf) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(w)).join(table(spark, sf, "part"), F.expr("p_partkey = l_partkey"))
    three = F.array(F.col("p_brand"), F.lower("p_brand"), F.concat(F.lit("w"), (F.col("l_suppkey") % 20).cast("string")))
    defines = F.when(F.col("l_partkey") % 9 == 0, F.array(*map(F.lit, ("a1", "b2", "c3", "d4", "e5")))).when(F.col("l_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(three)
    plan = rows.select(
        F.col("l_orderkey").alias("source_id"), "idx", F.when(F.col("l_partkey") % 31 == 0, "x").otherwise(F.expr("cast(3 * idx - 2 - l_suppkey % 7 div 6 as string)")).alias("start_line"),
        F.expr("cast(3 * idx - l_suppkey % 5 div 4 as string)").alias("end_line"), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.col("p_name")).alias("title"), defines.alias("defines"), F.lit("").alias("summary"),
        F.when(F.col("l_returnflag") == "A", "Excercise").when(F.col("l_returnflag") == "R", "odd").otherwise("concept").alias("unit_kind"),
    )
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg((3 * F.count("*")).cast("int").alias("line_count"))
    return plan, counts


@query(f"WITH {_PLAN} SELECT source_id, idx, s AS start_line, e AS end_line, name AS title, array_to_string(own, ',') AS defines, kind AS unit_kind, problem, valid FROM done")
def unit_partition(spark, sf):
    return R.partition(*_plan(spark, sf)).withColumn("defines", F.array_join("defines", ",")).drop("summary")


_SEMANTIC = """concept AS (SELECT * FROM done WHERE valid AND kind = 'concept'),
bare AS (SELECT source_id, 'empty_defines' AS problem_kind, '' AS key, s || '-' || e AS units FROM concept WHERE len(own) = 0),
keyed AS (SELECT DISTINCT source_id, s, e, name, idx, replace(lower(unnest(own)), '#', '#') AS key FROM concept),
twice AS (SELECT source_id, 'duplicate_defines' AS problem_kind, key, string_agg(s || '-' || e, ',' ORDER BY s, e, name) AS units FROM keyed WHERE source_id NOT IN (SELECT source_id FROM bare) GROUP BY source_id, key HAVING count(*) > 1)"""


@query(f"WITH {_PLAN}, {_SEMANTIC} SELECT * FROM bare UNION ALL SELECT * FROM twice")
def semantic_problems(spark, sf):
    parts = R.partition(*_plan(spark, sf)).where("valid")
    rows = R.semantic_problems(parts)
    span = F.transform("units", lambda u: F.concat_ws("-", u["start_line"].cast("string"), u["end_line"].cast("string")))
    return rows.select("source_id", F.col("kind").alias("problem_kind"), "key", F.array_join(span, ",").alias("units"))


_SPANS = """sp AS (SELECT source_id, s, e FROM done WHERE valid UNION ALL SELECT source_id, line_count + 1, line_count + 1 FROM n),
fr AS (SELECT *, coalesce(max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM sp),
gap AS (SELECT source_id, reach + 1 AS s, s - 1 AS e FROM fr WHERE s > reach + 1),
lap AS (SELECT source_id, s, least(e, prev) AS e FROM (SELECT source_id, s, e, lag(e) OVER (PARTITION BY source_id ORDER BY s, e) AS prev FROM done WHERE valid) WHERE s <= prev)"""


@query(f"""WITH {_PLAN}, {_SEMANTIC}, {_SPANS} SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM done WHERE problem <> 'defines') OR source_id IN (SELECT source_id FROM gap) OR source_id IN (SELECT source_id FROM lap) THEN 'coverage'
  WHEN source_id IN (SELECT source_id FROM done WHERE problem = 'defines') OR source_id IN (SELECT source_id FROM bare) OR source_id IN (SELECT source_id FROM twice) THEN 'metadata' END AS stage FROM n""")
def repair_stages(spark, sf):
    plan, counts = _plan(spark, sf)
    return R.repair_stage(R.partition(plan, counts), counts)


@query(f"""WITH {_PLAN}, {_SPANS}, said AS (SELECT source_id, 'invalid' AS kind, idx AS pos, idx || ':' || problem AS t FROM done WHERE NOT valid UNION ALL SELECT source_id, 'missing', s, s || '-' || e FROM gap UNION ALL SELECT source_id, 'overlap', s, s || '-' || e FROM lap),
few AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY source_id, kind ORDER BY pos, t) <= 3),
k AS (SELECT source_id, kind || '=' || string_agg(t, ', ' ORDER BY pos, t) AS t FROM few GROUP BY source_id, kind)
SELECT source_id, coalesce(string_agg(t, '; ' ORDER BY t), '') AS summary FROM n LEFT JOIN k USING (source_id) GROUP BY source_id""")
def partition_summaries(spark, sf):
    plan, counts = _plan(spark, sf)
    return R.partition_summary(R.partition(plan, counts), counts)


@query(f"""WITH {_PLAN} SELECT source_id, s AS start_line, e AS end_line, name AS title, idx % 3 = 0 OR (idx % 3 = 1 AND len(own) = 0 AND (kind <> 'concept' OR regexp_matches(lower(name || ' ' || name), '例题|习题|练习|应用|案例|示例|举例|题解|example|exercise|application|case|practice|problem'))) AS mergeable
FROM done WHERE valid QUALIFY row_number() OVER (PARTITION BY source_id, s, e, name ORDER BY idx) = 1""")
def mergeable_units(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id", "start_line", "end_line", "title").orderBy("idx")
    valid = R.partition(*_plan(spark, sf)).where("valid").select("source_id", "idx", "start_line", "end_line", "title", "defines", "summary", "unit_kind")
    units = stored(valid.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"), "units")
    kind = F.element_at(F.array(*map(F.lit, ("short_unit", "empty_defines", "duplicate_defines"))), (F.col("idx") % 3 + 1).cast("int"))
    return R.mergeable(units, units.select("source_id", "start_line", "end_line", "title", kind.alias("kind"))).select("source_id", "start_line", "end_line", "title", "mergeable")


_FLAT = "flat AS (SELECT source_id, 3 * idx - 2 AS s, 3 * idx AS e, CASE WHEN l_returnflag = 'A' THEN 'exercise' ELSE 'concept' END AS kind, l_returnflag = 'A' OR l_partkey % 5 = 0 AS gone FROM raw)"


def _flat(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(w))
    return rows.select(
        F.col("l_orderkey").alias("source_id"), (3 * F.col("idx") - 2).alias("start_line"), (3 * F.col("idx")).alias("end_line"), F.lit("u").alias("title"),
        F.when(F.col("l_returnflag") == "A", "exercise").otherwise("concept").alias("unit_kind"), ((F.col("l_returnflag") == "A") | (F.col("l_partkey") % 5 == 0)).alias("gone"),
    )


@query(f"""WITH {_PLAN.split('plan AS')[0].rstrip().rstrip(',')}, {_FLAT},
own AS (SELECT *, CASE WHEN NOT gone AND kind = 'concept' THEN s END AS c FROM flat),
t AS (SELECT *, last_value(c IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(c IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM own WINDOW w AS (PARTITION BY source_id ORDER BY s, e)),
k AS (SELECT source_id, coalesce(b, a) AS c, max(CASE WHEN b IS NOT NULL THEN e END) AS last, min(CASE WHEN b IS NULL THEN s END) AS first FROM t WHERE gone AND coalesce(b, a) IS NOT NULL GROUP BY 1, 2)
SELECT source_id, least(s, coalesce(first, s))::INTEGER AS start_line, greatest(e, coalesce(last, e))::INTEGER AS end_line, kind AS unit_kind FROM t LEFT JOIN k USING (source_id, c) WHERE NOT gone OR coalesce(b, a) IS NULL""")
def units_merged_into_concepts(spark, sf):
    rows = _flat(spark, sf)
    return R.merged_into_concepts(rows.drop("gone"), rows.where("gone").select("source_id", "start_line", "end_line", "title")).drop("title")


@query(f"""WITH {_PLAN.split('plan AS')[0].rstrip().rstrip(',')}, {_FLAT}
SELECT source_id, s::INTEGER AS start_line, e::INTEGER AS end_line, kind AS unit_kind FROM flat WHERE NOT gone UNION ALL SELECT source_id, s::INTEGER, e::INTEGER, 'fixed' FROM flat WHERE gone""")
def units_replaced_by_range(spark, sf):
    rows = _flat(spark, sf)
    fixes = rows.where("gone").select("source_id", "start_line", "end_line", "title", F.lit("fixed").alias("unit_kind"), F.col("start_line").alias("old_start"), F.col("end_line").alias("old_end"))
    return R.replaced_by_range(rows.drop("gone"), fixes).drop("title")


@query(f"""WITH {_PLAN.split('plan AS')[0].rstrip().rstrip(',')}, {_FLAT},
r AS (SELECT source_id, s, e, CASE WHEN s % 11 = 1 THEN [] WHEN s % 7 = 1 THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['k' || s % 5] END AS d FROM flat WHERE NOT gone OR source_id % 3 > 0),
b AS (SELECT source_id, bool_or(x.s IS NULL OR y.s IS NULL) AS ranges FROM r x FULL JOIN flat y USING (source_id, s, e) GROUP BY 1),
z AS (SELECT source_id, bool_or(len(d) = 0) AS none, bool_or(len(d) > 4) AS many FROM r GROUP BY 1),
w AS (SELECT DISTINCT source_id FROM (SELECT source_id, unnest(d) AS k FROM r) GROUP BY source_id, k HAVING count(*) > 1)
SELECT b.source_id, CASE WHEN ranges THEN 'ranges' WHEN none THEN 'no_defines' WHEN many THEN 'too_many_defines' WHEN w.source_id IS NOT NULL THEN 'duplicate_defines' END AS problem FROM b LEFT JOIN z USING (source_id) LEFT JOIN w USING (source_id)""")
def define_repair_problems(spark, sf):
    rows = _flat(spark, sf)
    s = F.col("start_line")
    defines = F.when(s % 11 == 1, F.array().cast("array<string>")).when(s % 7 == 1, F.array(*map(F.lit, "abcde"))).otherwise(F.array(F.concat(F.lit("k"), (s % 5).cast("string"))))
    repairs = rows.where("not gone or source_id % 3 > 0").select("source_id", "start_line", "end_line", defines.alias("defines"))
    return R.define_repair_problems(repairs, rows)


@query(f"""WITH {_PLAN.split('plan AS')[0].rstrip().rstrip(',')}, {_FLAT}, win AS (SELECT source_id, 1 + source_id % 2 * 3 AS a, max(e) - source_id % 5 // 4 AS b FROM flat GROUP BY 1),
inside AS (SELECT f.source_id, s, e, a, b, coalesce(lag(e) OVER w + 1, a) AS expected, row_number() OVER w AS ord FROM flat f JOIN win USING (source_id) WHERE NOT gone WINDOW w AS (PARTITION BY f.source_id ORDER BY s, e)),
p AS (SELECT *, CASE WHEN s < a OR e > b THEN 'outside' WHEN s < expected THEN 'overlap' WHEN s > expected THEN 'gap' END AS problem FROM inside)
SELECT win.source_id, coalesce(arg_min(problem, ord) FILTER (problem IS NOT NULL), CASE WHEN coalesce(max(e), any_value(win.a) - 1) < any_value(win.b) THEN 'gap' ELSE 'ok' END) AS problem FROM win LEFT JOIN p USING (source_id) GROUP BY win.source_id""")
def window_tiling(spark, sf):
    rows = _flat(spark, sf)
    windows = rows.groupBy("source_id").agg(F.max("end_line").alias("last")).select("source_id", F.expr("1 + source_id % 2 * 3").alias("window_start"), F.expr("last - source_id % 5 div 4").alias("window_end"))
    return R.window_tiling(rows.where("not gone").select("source_id", "start_line", "end_line"), windows)


@query(f"""WITH {_PLAN.split('plan AS')[0].rstrip().rstrip(',')}, {_FLAT}
SELECT a.source_id, a.s::INTEGER AS at, ((b.s - a.s) // 3)::INTEGER AS "offset", b.s::INTEGER AS start_line, b.e::INTEGER AS end_line, 'u' AS title FROM flat a JOIN flat b ON a.source_id = b.source_id AND b.s BETWEEN a.s - 3 AND a.s + 3 WHERE a.gone""")
def repair_windows(spark, sf):
    rows = _flat(spark, sf)
    return L.repair_window(rows, rows.where("gone"))


# Graphs


@query("SELECT n_nationkey AS node, r_name AS collection, ((dense_rank() OVER (ORDER BY r_name) - 1) % 3)::INTEGER AS colour FROM nation JOIN region ON r_regionkey = n_regionkey")
def node_palette(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    return G.palette(rows.select(F.col("n_nationkey").alias("node"), F.array("r_name").alias("collections")), colours=3)


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS hard, count(*) FILTER (l_returnflag = 'R') AS soft FROM lineitem")
def edge_counts(spark, sf):
    relation = F.when(F.col("l_returnflag") == "A", "prerequisite").when(F.col("l_returnflag") == "R", "order").otherwise("other")
    return G.edge_counts(table(spark, sf, "lineitem").select(relation.alias("relation")))
