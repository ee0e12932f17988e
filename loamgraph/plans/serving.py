"""Queries of the read side: evidence and context of nodes, views, the chunk index, and tables of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import ids as I
from loamgraph.operators import evidence as E
from loamgraph.operators import graph as G
from loamgraph.operators import schedule as K
from loamgraph.operators import views as V
from loamgraph.plans.registry import query
from loamgraph.sources import index as X
from loamgraph.sources import state as A
from loamgraph.sources.stages import stored, table

# Evidence: an order is a node, its parts are the units it is made of, suppliers' offers are hits

_LINE = "line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS pos FROM lineitem)"


def _line(spark, sf) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w))


@query("""WITH c AS (SELECT p_partkey AS unit, arg_min(o_orderkey, (o_orderkey % 7, o_orderkey)) AS chunk FROM part JOIN orders ON o_orderkey % 300 = p_partkey GROUP BY 1)
SELECT DISTINCT l_orderkey AS node, l_partkey AS unit, chunk::VARCHAR AS chunk_id, o_orderpriority AS text FROM lineitem LEFT JOIN c ON unit = l_partkey LEFT JOIN orders ON o_orderkey = chunk""")
def source_evidence(spark, sf):
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part").select("p_partkey")
    chunks = orders.join(part, F.expr("o_orderkey % 300 = p_partkey")).select(F.col("p_partkey").alias("unit"), (F.col("o_orderkey") % 7).alias("chunk_index"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"))
    wanted = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("unit"))
    return E.source_evidence(wanted, chunks).withColumn("chunk_id", F.col("chunk_id").cast("string"))


_HITS = f"""{_LINE}, req AS (SELECT l_orderkey AS node, pos AS ord, CASE WHEN l_suppkey % 3 = 0 THEN 'c' || l_partkey % 50 || '-' || l_linenumber % 2 END AS chunk_id, l_partkey % 50 AS unit, 'r' || pos AS text FROM line WHERE l_returnflag = 'A'),
sem AS (SELECT l_orderkey AS node, pos AS ord, CASE WHEN l_suppkey % 3 = 0 THEN 'c' || l_partkey % 50 || '-' || l_linenumber % 2 END AS chunk_id, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 50 END AS unit, CASE WHEN l_suppkey % 4 = 0 THEN 's' || l_partkey % 5 ELSE 's' || pos END AS text FROM line WHERE l_returnflag <> 'A'),
every AS (SELECT 0 AS g, * FROM req UNION ALL SELECT 1, * FROM sem),
hit AS (SELECT node, g, ord, chunk_id, unit, text FROM every QUALIFY row_number() OVER (PARTITION BY node, coalesce(chunk_id, unit::VARCHAR, text) ORDER BY g, ord) = 1)"""


def _hits(spark, sf) -> tuple[DataFrame, DataFrame]:
    line = _line(spark, sf)
    pos, unit = F.col("pos").cast("string"), (F.col("l_partkey") % 50).cast("int")
    chunk = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("c"), unit.cast("string"), F.lit("-"), (F.col("l_linenumber") % 2).cast("string")))
    node = F.col("l_orderkey").alias("node"), F.col("pos").alias("ord"), chunk.alias("chunk_id")
    required = line.where("l_returnflag = 'A'").select(*node, unit.alias("unit"), F.concat(F.lit("r"), pos).alias("text"))
    none = F.col("l_suppkey") % 4 == 0
    semantic = line.where("l_returnflag <> 'A'").select(*node, F.when(~none, unit).alias("unit"), F.concat(F.lit("s"), F.when(none, (F.col("l_partkey") % 5).cast("string")).otherwise(pos)).alias("text"))
    return required, semantic


@query(f"WITH {_HITS} SELECT node, chunk_id, unit::INTEGER AS unit, text, row_number() OVER (PARTITION BY node ORDER BY g, ord)::INTEGER AS place FROM hit")
def evidence_hits(spark, sf):
    return E.deduped_hits(*_hits(spark, sf))


@query(f"WITH {_HITS} SELECT DISTINCT l_orderkey AS node, (l_partkey % 50)::INTEGER AS unit FROM lineitem WHERE (l_orderkey, l_partkey % 50) NOT IN (SELECT (node, unit) FROM hit WHERE unit IS NOT NULL)")
def missing_evidence(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") % 50).cast("int").alias("unit"))
    return E.missing_evidence(members, E.deduped_hits(*_hits(spark, sf)))


@query(f"""WITH {_LINE} SELECT l_orderkey AS node, '## 来源追溯' || chr(10) || coalesce(chr(10) || string_agg('- `' || p_brand || '.md`，' || CASE WHEN p_size % 10 = 0 THEN '行范围未知' ELSE '第 ' || p_size || '–' || p_size + 5 || ' 行' END || '（`' || l_partkey || '`）', chr(10) ORDER BY pos) FILTER (l_partkey % 7 > 0), '') AS trace,
  coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey % 7 = 0)), ','), '') AS missing FROM line JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def source_traces(spark, sf):
    part = table(spark, sf, "part")
    known = part.where("p_partkey % 7 > 0").select(
        F.col("p_partkey").alias("unit"), F.concat(F.lit("books\\"), F.lower("p_brand"), F.lit("/"), F.col("p_brand"), F.lit(".md")).alias("source"),
        F.when(F.col("p_size") % 10 > 0, F.col("p_size")).alias("start_line"), (F.col("p_size") + 5).alias("end_line"),
    )
    members = _line(spark, sf).join(part.select("p_partkey"), F.expr("p_partkey = l_partkey")).select(F.col("l_orderkey").alias("node"), "pos", F.col("l_partkey").alias("unit"))
    return E.source_trace(members, known).withColumn("missing", F.array_join("missing", ","))


_TREE = """o AS (SELECT o_orderkey AS node, lead(o_orderkey, 1) OVER w AS n1, lead(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT node AS src, n1 AS dst FROM o WHERE n1 IS NOT NULL UNION SELECT node, n2 FROM o WHERE n2 IS NOT NULL),
num AS (SELECT o_orderkey AS node, printf('%03d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS seq, o_orderpriority AS title FROM orders)"""


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.array(F.lead("o_orderkey", 1).over(w), F.lead("o_orderkey", 2).over(w)).alias("next"), F.col("o_custkey").alias("customer"))
    edges = rows.select("src", F.explode("next").alias("dst"), "customer").where("dst is not null")
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("title"), "o_orderdate", "o_custkey", "o_orderstatus")
    return G.sequence_labels(nodes, "o_orderdate", "node"), edges


@query(f"""WITH {_TREE}, p AS (SELECT dst, string_agg('- ' || CASE WHEN src % 3 > 0 THEN '[' || o_orderpriority || '](o/' || src || '.md)' ELSE o_orderpriority END || CASE WHEN src % 2 = 0 THEN '：相关先修 defines：' || dst % 10 || '、q' WHEN src % 5 = 0 THEN '' ELSE '：相关先修 defines：d' || src END || '。', chr(10) ORDER BY src) AS t FROM edges JOIN orders ON o_orderkey = src GROUP BY dst)
SELECT num.node, '# ' || seq || '. ' || regexp_replace(title, '^\\d{{1,4}}[.．、_\\-\\s]+', '') || chr(10) || chr(10) || '## 先修前置' || chr(10) || chr(10) || coalesce('本节点由 DAG 判定需要先掌握以下已完成节点：' || chr(10) || t, '本节点无材料内先修节点。')
  || CASE WHEN num.node % 4 = 0 THEN chr(10) || chr(10) || '材料外基础：' || chr(10) || '- e' ELSE '' END AS preamble FROM num LEFT JOIN p ON dst = num.node""".replace("{{", "{").replace("}}", "}"))
def draft_preambles(spark, sf):
    labels, edges = _tree(spark, sf)
    none = F.array().cast("array<string>")
    nodes = labels.select("node", F.col("node").alias("ord"), "seq", "title", F.when(F.col("node") % 5 > 0, F.array(F.concat(F.lit("d"), F.col("node").cast("string")))).otherwise(none).alias("defines"), F.when(F.col("node") % 4 == 0, F.array(F.lit("e"))).otherwise(none).alias("external"))
    need = F.when(F.col("src") % 2 == 0, F.array((F.col("dst") % 10).cast("string"), F.lit("q"))).otherwise(none)
    ledger = labels.where("node % 3 > 0").select(F.lit(1).alias("ord"), "node", F.concat(F.lit("outputs/o/"), F.col("node").cast("string"), F.lit(".md")).alias("output_path"))
    return E.draft_preamble(nodes, edges.withColumn("required", need), ledger)


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN conv_id::VARCHAR ELSE 'unknown' END AS source, least(length(text), 900) AS own, sum(least(length(text), 900)) OVER (PARTITION BY conv_id ORDER BY turn) - least(length(text), 900) AS used FROM conversations)
SELECT conv_id, turn, source, least(own, 2500 - used)::INTEGER AS taken FROM h WHERE used < 2500""")
def retrieved_hits(spark, sf):
    turn = F.col("turn")
    hits = table(spark, sf, "conversations").select("conv_id", "turn", turn.alias("place"), F.when(turn % 3 == 0, F.col("role")).alias("path"), F.lit("").alias("filename"), F.when(turn % 3 == 1, F.col("conv_id")).alias("doc_id"), F.lit(None).cast("string").alias("content_kind"), "text")
    return E.retrieved(hits, group="conv_id", total=2500, each=900).select("conv_id", "turn", "source", "taken")


@query(f"""WITH RECURSIVE {_TREE}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
t AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'P')
SELECT node, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM edges WHERE dst = node), '') AS parents, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM reach JOIN orders ON o_orderkey = src AND o_orderstatus = 'F' WHERE dst = node), '') AS visible,
  coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM reach WHERE src = node), '') AS future,
  (SELECT count(*) FROM orders) - 1 - (SELECT count(*) FROM reach WHERE src = node) - (SELECT count(*) FROM reach JOIN orders ON o_orderkey = src AND o_orderstatus = 'F' WHERE dst = node) AS n_siblings FROM t""")
def node_contexts(spark, sf):
    labels, edges = _tree(spark, sf)
    targets = labels.where("o_orderstatus = 'P'").select("node")
    covered = labels.where("o_orderstatus = 'F'").select(F.col("node").alias("other"))
    visible = G.relatives(targets, edges, down=False, part="customer").join(covered, "other", "left_semi").select("node", "other")
    rows = E.node_context(targets, labels, edges, visible, G.relatives(targets, edges, part="customer"))
    return rows.select("node", *[F.array_join(c, ",").alias(c) for c in ("parents", "visible", "future")], "n_siblings")


@query(f"""WITH RECURSIVE {_TREE}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
led AS (SELECT node AS record, unnest([node, n1]) AS nid, CASE WHEN n1 IS NULL THEN 1 ELSE 2 END AS n FROM o WHERE node % 3 > 0), s AS (SELECT dst AS node, record, n, count(*) AS seen FROM led JOIN reach ON src = nid WHERE nid IS NOT NULL GROUP BY 1, 2, 3)
SELECT node, 'o/' || record AS output_path FROM s WHERE seen = n AND record % 4 > 0""")
def prior_outputs(spark, sf):
    labels, edges = _tree(spark, sf)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "node")
    rows = labels.withColumn("n1", F.lead("node").over(w)).where("node % 3 > 0")
    ledger = rows.select(F.col("node").alias("record"), F.filter(F.array("node", "n1"), lambda x: x.isNotNull()).alias("node_ids"), F.concat(F.lit("o/"), F.col("node").cast("string")).alias("output_path"))
    files = labels.where("node % 4 > 0").select(F.concat(F.lit("o/"), F.col("node").cast("string")).alias("path"))
    return E.prior_outputs(ledger, G.relatives(labels.select("node"), edges, down=False, part="customer"), files)


# Views


def _ledger(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.array("o_custkey", F.col("o_custkey") + 1).alias("node_ids"), F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("output_path"))


@query("SELECT node, string_agg('o/' || o_orderkey, ',' ORDER BY o_orderkey) AS paths FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS node FROM orders WHERE o_orderkey % 9 > 0) GROUP BY node")
def output_paths(spark, sf):
    return V.output_paths(_ledger(spark, sf)).withColumn("paths", F.array_join("paths", ","))


@query("SELECT node, 'o/' || min(o_orderkey) AS output_path FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS node FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 2 = 0) GROUP BY node")
def first_outputs(spark, sf):
    files = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"))
    return V.first_output(_ledger(spark, sf), files)


_VIEW = f"""{_TREE}, st AS (SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '2-HIGH' THEN 'running'
  WHEN o_orderkey IN (SELECT dst FROM edges JOIN orders p ON p.o_orderkey = src WHERE p.o_orderstatus <> 'F') THEN 'locked' ELSE 'ready' END AS status FROM orders),
rd AS (SELECT o_orderkey AS node, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'read' WHEN o_orderpriority = '5-LOW' THEN 'reading' ELSE 'unread' END AS own FROM orders),
hit AS (SELECT st.node, status = 'complete' AND own = 'unread' AND st.node NOT IN (SELECT dst FROM edges JOIN rd p ON p.node = src WHERE p.own <> 'read') AS hit FROM st JOIN rd USING (node)),
shown AS (SELECT num.node, title, seq || '. ' || title AS label, status, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM edges WHERE dst = num.node), '') AS prerequisites, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM edges WHERE src = num.node), '') AS dependents,
  CASE WHEN num.node % 3 = 0 THEN 'o/' || num.node ELSE '' END AS paths, CASE WHEN hit THEN 'recommended' ELSE own END AS reading_status,
  CASE WHEN hit AND num.node NOT IN (SELECT dst FROM edges) THEN 'root_ready' WHEN hit THEN 'prerequisites_read' END AS reason, (SELECT bool_and(status = 'complete') FROM st) AS ready FROM num JOIN st USING (node) JOIN rd USING (node) JOIN hit USING (node))"""


def _view(spark, sf) -> DataFrame:
    labels, edges = _tree(spark, sf)
    p = F.col("title")
    state = labels.select("node", (F.col("o_orderstatus") == "F").alias("covered"), (p == "1-URGENT").alias("failed"), (p == "2-HIGH").alias("active"))
    status = stored(K.node_status(labels.select("node"), edges, state), "status")
    reading = K.reading_view(status, edges, labels.select("node", F.when(p == "3-MEDIUM", "read").when(p == "5-LOW", "reading").otherwise("").alias("reading_status")))
    outputs = V.output_paths(labels.where("node % 3 = 0").select(F.lit(1).alias("ord"), F.array("node").alias("node_ids"), F.concat(F.lit("o/"), F.col("node").cast("string")).alias("output_path")))
    return V.graph_view(labels.select("node", "title", "label"), status, edges, outputs, reading)


@query(f"WITH {_VIEW} SELECT * FROM shown")
def graph_view(spark, sf):
    return _view(spark, sf).select("node", "title", "label", "status", *[F.array_join(c, ",").alias(c) for c in ("prerequisites", "dependents", "paths")], "reading_status", "reason", "ready")


@query(f"""WITH {_VIEW}, r AS (SELECT CASE status WHEN 'failed' THEN 'blighted' WHEN 'locked' THEN 'set' WHEN 'ready' THEN 'unripe' WHEN 'running' THEN 'turning' ELSE CASE reading_status WHEN 'read' THEN 'picked' WHEN 'recommended' THEN 'ripe' WHEN 'reading' THEN 'ripe' ELSE 'almost' END END AS ripeness FROM shown)
SELECT d.ripeness, count(r.ripeness) AS n FROM (SELECT unnest(['blighted', 'set', 'unripe', 'turning', 'picked', 'ripe', 'almost']) AS ripeness) d LEFT JOIN r USING (ripeness) GROUP BY d.ripeness""")
def ripeness_counts(spark, sf):
    return K.histogram(K.ripeness(_view(spark, sf)), "ripeness", ["blighted", "set", "unripe", "turning", "picked", "ripe", "almost"])


_STAGE_SQL = """d AS (SELECT user_id AS project, ['ocr', 'clean', 'cut', 'embed', 'cluster'][list_position(['click', 'view', 'purchase', 'signup', 'logout'], event_type)] AS stage, count(*) FILTER (value > 50) AS done, count(*) AS total, ['running', 'pending', 'complete', 'active'][user_id % 4 + 1] AS status FROM events GROUP BY ALL)"""


def _stages(spark, sf) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "logout"), V.STAGES) for x in pair])
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("project"), names[F.col("event_type")].alias("stage")).agg(F.count_if(F.col("value") > 50).alias("done"), F.count("*").alias("total"))
    return rows.withColumn("status", F.element_at(F.array(*map(F.lit, ("running", "pending", "complete", "active"))), (F.col("project") % 4 + 1).cast("int")))


@query(f"""WITH {_STAGE_SQL}, x AS (SELECT *, project % 3 = 0 AS ended, done % 2 = 0 AND total > 1 AS erred FROM d)
SELECT project, stage, done, total, round_even(done / total * 100, 0)::INTEGER AS pct, CASE WHEN ended AND erred THEN 'failed' WHEN ended AND status IN ('running', 'active') THEN CASE WHEN done > 0 THEN 'partial' ELSE 'pending' END ELSE status END AS status,
  CASE WHEN erred THEN CASE WHEN project % 2 = 0 THEN 'file' || total ELSE 'broken' END WHEN project % 5 = 0 THEN 'said' ELSE 'a, b' END AS current FROM x WHERE stage IS NOT NULL""")
def stage_rows(spark, sf):
    stages = _stages(spark, sf).where("stage is not null")
    project = F.col("project")
    errors = stages.where("done % 2 = 0 and total > 1").select("project", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "stage", F.when((project % 2 == 0) & (F.col("ord") == 2), F.concat(F.lit("file"), F.col("total").cast("string"))).otherwise("").alias("resource"), F.lit("broken").alias("message"))
    rows = stages.withColumn("message", F.when(project % 5 == 0, "said").otherwise("")).withColumn("active", F.array(F.lit("a"), F.lit("b")))
    return V.stage_rows(rows, errors, F.when(project % 3 == 0, "failed").otherwise("running"))


@query(f"WITH {_STAGE_SQL}, p AS (SELECT DISTINCT user_id AS project FROM events), s AS (SELECT unnest(['ocr', 'clean', 'cut', 'embed', 'cluster', 'link', 'noderun']) AS stage) SELECT p.project, s.stage, coalesce(done, 0) AS done, coalesce(total, 0) AS total, coalesce(status, 'pending') AS status FROM p CROSS JOIN s LEFT JOIN d ON d.project = p.project AND d.stage = s.stage")
def stage_defaults(spark, sf):
    return V.with_stage_defaults(_stages(spark, sf), table(spark, sf, "events").select(F.col("user_id").alias("project")).distinct())


@query("""WITH x AS (SELECT o_custkey AS project, o_orderkey AS node, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'Failed' WHEN '5-LOW' THEN 'blocked' ELSE 'in_progress' END AS status, o_orderstatus = 'F' AS covered FROM orders)
SELECT project, count(*) AS nodes, count(*) FILTER (covered) AS covered, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('Failed', 'blocked')) AS failed, CASE WHEN project % 2 = 0 THEN count(*) FILTER (status = 'in_progress') ELSE 0 END AS active, bool_and(covered) AS all_covered FROM x GROUP BY project""")
def run_overview(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("node"), "o_orderpriority", "o_orderstatus")
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "completed").when(p == "2-HIGH", "Failed").when(p == "5-LOW", "blocked").otherwise("in_progress")
    return V.run_overview(rows.select("project", "node", status.alias("status")), rows, rows.where("o_orderstatus = 'F'").select("project", "node"), rows.where("project % 2 = 0").select("project"))


@query("""SELECT DISTINCT node FROM (SELECT o_custkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def failed_nodes(spark, sf):
    return V.failed_nodes(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("node")), table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node")))


@query("""SELECT c_nationkey AS project, c_custkey AS ord, 'at ' || 'n' || c_nationkey || '.md' || ' and ' || 'n' || c_nationkey || '.md' || '.part in m' || c_custkey AS message FROM customer""")
def shown_errors(spark, sf):
    nation = F.col("c_nationkey").cast("string")
    path = F.concat(F.lit("/m/"), nation, F.lit("/n"), nation, F.lit(".md"))
    errors = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("ord"), F.concat(F.lit("at "), path, F.lit(" and "), path, F.lit(".part in m"), F.col("c_custkey").cast("string")).alias("message"))
    own = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_nationkey").cast("string").alias("k"))
    path = F.concat(F.lit("/m/"), F.col("k"), F.lit("/n"), F.col("k"), F.lit(".md"))
    return V.shown_errors(errors, own.select("project", path.alias("resource")).unionByName(own.select("project", F.concat(path, F.lit(".part")).alias("resource"))).unionByName(own.select("project", F.lit(" ").alias("resource"))))


@query("SELECT source AS project, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def project_sizes(spark, sf):
    return V.project_sizes(table(spark, sf, "documents").select(F.col("source").alias("project"), F.col("n_chars").alias("length")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'clean,cut,embed,cluster,link,noderun' WHEN c_custkey % 2 = 0 THEN 'cluster,link,noderun' ELSE 'noderun' END AS stages FROM customer""")
def invalidated_stages(spark, sf):
    k = F.col("c_custkey")
    settings = lambda a, b, c: F.create_map(F.lit("chunk"), a, F.lit("threshold"), b, F.lit("mode"), c)
    one, two = F.lit("1"), F.lit("2")
    still = k % 5 == 0
    after = settings(F.when(~still & (k % 3 == 0), two).otherwise(one), F.when(~still & ((k % 2 == 0) | (k % 3 == 0)), two).otherwise(one), F.when(still, one).otherwise(two))
    stages = V.invalidated(settings(one, one, one), after, {"chunk": "clean", "threshold": "cluster", "mode": "noderun"})
    return table(spark, sf, "customer").select("c_custkey", F.array_join(stages, ",").alias("stages"))


# Index: a document's turns are its chunks; an embedding stands for each


def _index(spark, sf) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("vector"))
    vectors = vectors.withColumn("vector", F.when(F.col("vec_id") % 37 == 0, F.transform("vector", lambda x: F.lit(float("nan")))).when(F.col("vec_id") % 41 == 0, F.slice("vector", 1, 2)).otherwise(F.col("vector")))
    rows = vectors.select((F.col("vec_id") / 4).cast("long").alias("doc_id"), F.col("vec_id").alias("chunk"), "vector")
    old = rows.where("doc_id % 3 > 0").select("doc_id", "chunk", F.lit(4).alias("document_chunk_count"), "vector", F.lit("old").alias("version"))
    new = rows.where("doc_id % 2 = 0 and (doc_id % 10 > 0 or chunk % 4 > 0)").select("doc_id", "chunk", F.lit(4).alias("document_chunk_count"), "vector", F.lit("new").alias("version"))
    return old, new


_INDEX = """v AS (SELECT vec_id // 4 AS doc_id, vec_id AS chunk FROM embeddings), new AS (SELECT * FROM v WHERE doc_id % 2 = 0 AND (doc_id % 10 > 0 OR chunk % 4 > 0)), old AS (SELECT * FROM v WHERE doc_id % 3 > 0),
bad AS (SELECT doc_id, CASE WHEN count(*) <> 4 THEN 'count' WHEN bool_or(chunk % 41 = 0 AND chunk % 37 > 0) THEN 'dimensions' WHEN bool_or(chunk % 37 = 0) THEN 'not_finite' END AS problem FROM new GROUP BY doc_id)"""


@query(f"WITH {_INDEX} SELECT * FROM bad")
def chunk_problems(spark, sf):
    return X.chunk_problems(_index(spark, sf)[1], dims=4)


@query(f"WITH {_INDEX}, good AS (SELECT doc_id FROM bad WHERE problem IS NULL) SELECT doc_id, chunk, 'new' AS version FROM new WHERE doc_id IN (SELECT doc_id FROM good) UNION ALL SELECT doc_id, chunk, 'old' FROM old WHERE doc_id NOT IN (SELECT doc_id FROM good)")
def indexed_documents(spark, sf):
    return X.index_documents(*_index(spark, sf), dims=4).select("doc_id", "chunk", "version")


@query(f"WITH {_INDEX} SELECT doc_id, chunk FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def deleted_documents(spark, sf):
    old, new = _index(spark, sf)
    return X.delete_documents(old, new).select("doc_id", "chunk")


@query("SELECT l_partkey AS unit, max(l_orderkey) AS node FROM lineitem GROUP BY l_partkey")
def unit_nodes(spark, sf):
    nodes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.collect_set("l_partkey").alias("members")).withColumn("node", F.col("ord"))
    return X.unit_nodes(nodes)


@query("""WITH n AS (SELECT l_partkey AS unit, max('kn:' || l_orderkey) FILTER (l_orderkey % 3 > 0) AS id FROM lineitem GROUP BY 1)
SELECT p_partkey AS unit, CASE WHEN p_size % 2 = 0 THEN coalesce(id, 'old') ELSE 'old' END AS node_id FROM part LEFT JOIN n ON unit = p_partkey""")
def backfilled_node_ids(spark, sf):
    index = table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.when(F.col("p_size") % 2 == 0, "source").otherwise("finished").alias("content_kind"), F.lit("old").alias("node_id"))
    nodes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit"), F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("kn:"), F.col("l_orderkey").cast("string"))).otherwise("").alias("node_id"))
    return X.with_node_ids(index, nodes).select("unit", "node_id")


@query("SELECT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 5)")
def unindexed_units(spark, sf):
    return X.unindexed(table(spark, sf, "part").select(F.col("p_partkey").alias("unit")), table(spark, sf, "lineitem").where("l_linenumber > 5").select(F.col("l_partkey").alias("unit")))


@query("SELECT p_partkey::VARCHAR AS doc_id, p_brand || '/' || p_name AS path, p_name AS filename FROM part")
def unit_documents(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), F.col("p_brand").alias("collection"), F.col("p_name").alias("source_file"), F.col("p_type").alias("text"))
    return X.unit_documents(rows).select("doc_id", "path", "filename")


@query("SELECT 'finished:' || n_regionkey || ':out/' || printf('%03d', n_nationkey) || '.' || n_name || '.md' AS doc_id, n_regionkey::VARCHAR AS collection, printf('%03d', n_nationkey) AS file_seq FROM nation")
def finished_documents(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("node"), F.concat(F.lit("out/"), F.format_string("%03d", "n_nationkey"), F.lit("."), F.col("n_name"), F.lit(".md")).alias("path"), F.col("n_name").alias("text"))
    return X.finished_documents(rows).select("doc_id", "collection", "file_seq")


@query("SELECT o_orderkey AS record FROM orders WHERE o_orderstatus = 'F'")
def committed_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("generation_id"))
    return X.current(rows, spark.createDataFrame([("F",)], "generation_id string")).select("record")


# State


@query("""WITH l AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'purchase' THEN '  Run FAILED at ' || event_id WHEN 'signup' THEN 'python is likely shutting down: error: x' WHEN 'click' THEN 'error: sys.meta_path is None' || CASE WHEN event_id % 2 = 0 THEN ' in QdrantClient' ELSE '' END ELSE 'all well' END AS line FROM events),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos DESC) <= 8)
SELECT file, pos AS "at", trim(line) AS line FROM t WHERE contains(line, 'FAILED') OR line LIKE '%None' ORDER BY file DESC, pos DESC LIMIT 5""")
def log_errors(spark, sf):
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "purchase", F.concat(F.lit("  Run FAILED at "), n)).when(kind == "signup", "python is likely shutting down: error: x")
    line = line.when(kind == "click", F.concat(F.lit("error: sys.meta_path is None"), F.when(F.col("event_id") % 2 == 0, " in QdrantClient").otherwise(""))).otherwise("all well")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at"), line.alias("line"))
    return A.log_errors(rows, tail=8, last=5).select("file", F.col("at").cast("long").alias("at"), "line")


@query("""WITH i AS (SELECT source || '/' || doc_id || '.md' AS p, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'n' || doc_id END AS name, doc_id FROM documents WHERE doc_id % 3 > 0), f AS (SELECT source || '/' || doc_id || '.md' AS p, sha256(text) AS h, doc_id FROM documents WHERE doc_id % 5 > 0)
SELECT p AS relative_path, coalesce(nullif(name, ''), i.doc_id || '.md') AS original_name, 'x' AS sha256, CASE WHEN h IS NULL THEN 'missing' ELSE 'active' END AS status, split_part(p, '/', 1) AS collection FROM i LEFT JOIN f USING (p)
UNION ALL SELECT p, doc_id || '.md', h, 'active', split_part(p, '/', 1) FROM f WHERE p NOT IN (SELECT p FROM i)""")
def imported_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.sha2("text", 256).alias("sha256"))
    name = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    imports = docs.where("doc_id % 3 > 0").select("relative_path", name.alias("original_name"), F.lit("x").alias("sha256"))
    return A.imported_files(imports, docs.where("doc_id % 5 > 0").select("relative_path", "sha256"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN p_name ELSE p_name || '.part-' || printf('%03d', p_partkey) END AS name FROM part")
def part_names(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("source_file"), F.col("p_partkey").alias("part"), F.col("p_size").alias("parts"))
    return A.part_names(rows).select("p_partkey", "name")


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'mine' ELSE r_name END AS text, n_nationkey % 3 = 0 AS overridden, n_nationkey % 6 = 0 AS base_changed FROM nation JOIN region ON r_regionkey = n_regionkey""")
def prompt_settings(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    mine = rows.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit("mine").alias("text"), F.when(F.col("n_nationkey") % 6 == 0, "other").otherwise(I.prompt_hash(F.col("r_name"))).alias("base_hash"))
    return A.prompt_settings(rows.select(F.col("n_name").alias("name"), F.col("r_name").alias("text")), mine)


@query("""WITH e AS (SELECT user_id AS node, event_id, CASE event_type WHEN 'purchase' THEN 'fail' WHEN 'signup' THEN 'retry' WHEN 'logout' THEN 'complete' WHEN 'view' THEN 'reset' ELSE 'start' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'fast' WHEN event_id % 3 = 1 THEN 'standard' END AS mode FROM events),
l AS (SELECT node, arg_max(kind, event_id) FILTER (kind <> 'start') AS kind, max(event_id) FILTER (kind <> 'start') AS pos, max(event_id) FILTER (kind = 'reset') AS reset_at, bool_or(kind = 'fail') AS failed FROM e GROUP BY node),
m AS (SELECT e.node, arg_min(mode, event_id) AS mode FROM e JOIN l USING (node) WHERE mode IS NOT NULL AND (reset_at IS NULL OR event_id > reset_at) GROUP BY e.node)
SELECT node, CASE kind WHEN 'fail' THEN 'failed' WHEN 'complete' THEN 'completed' WHEN 'reset' THEN 'in_progress' WHEN 'retry' THEN CASE WHEN failed THEN 'in_progress' ELSE 'queued' END ELSE 'queued' END AS status,
  CASE WHEN reset_at IS NULL AND node % 2 = 0 THEN 'fast' ELSE mode END AS mode, CASE WHEN kind = 'fail' THEN 'e' || pos WHEN kind IN ('reset', 'retry') THEN NULL ELSE 'old' END AS error FROM l LEFT JOIN m USING (node)""")
def execution_states(spark, sf):
    events = table(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "fail", "signup", "retry", "logout", "complete", "view", "reset")])
    n = F.col("event_id")
    rows = events.select(F.col("user_id").alias("node"), n.alias("ord"), F.coalesce(kinds[F.col("event_type")], F.lit("start")).alias("kind"), F.when(n % 3 == 0, "fast").when(n % 3 == 1, "standard").alias("mode"), F.concat(F.lit("e"), n.cast("string")).alias("error"))
    start = events.select(F.col("user_id").alias("node")).distinct().select("node", F.lit("queued").alias("status"), F.when(F.col("node") % 2 == 0, "fast").alias("mode"), F.lit("old").alias("error"))
    return A.after_events(start, rows)


@query("""WITH t AS (SELECT user_id, event_type, arg_max(event_id % 2 = 0, event_id) AS on_ FROM events GROUP BY ALL), a AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (on_) AS active FROM t GROUP BY 1)
SELECT user_id::VARCHAR AS stage, coalesce(active, '') AS active, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN active IS NOT NULL THEN 'running' WHEN user_id % 3 > 0 THEN 'complete' ELSE 'pending' END AS status FROM a""")
def stage_activities(spark, sf):
    e = table(spark, sf, "events")
    stage = F.col("user_id").cast("string").alias("stage")
    events = e.select(stage, F.col("event_id").alias("ord"), F.col("event_type").alias("token"), (F.col("event_id") % 2 == 0).alias("started"))
    stages = e.select("user_id").distinct().select(stage, (F.col("user_id") % 3).alias("done"), F.lit(1).alias("total"), (F.col("user_id") % 7 == 0).alias("failed"))
    return A.activities(events, stages).withColumn("active", F.array_join("active", ","))


@query("SELECT o_orderkey AS record, o_orderstatus IN ('F') AS kept FROM orders")
def ledger_generations(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("generation_id"))
    own, rest = A.split_generations(rows, "F")
    return own.select("record", F.lit(True).alias("kept")).unionByName(rest.select("record", F.lit(False).alias("kept")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 1 THEN '{"b": [1, 2]}' END AS object FROM customer""")
def json_objects(spark, sf):
    k = F.col("c_custkey")
    n = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit('```json\n{"a":'), n, F.lit("}\n```"))).when(k % 4 == 1, '  {"b": [1, 2]} ').when(k % 4 == 2, F.concat(F.lit('{"a": '), n, F.lit("} and more"))).otherwise("[1]")
    return table(spark, sf, "customer").select("c_custkey", I.json_object(raw).alias("object"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN 90.0 END AS delay FROM customer")
def retry_delays(spark, sf):
    k = F.col("c_custkey")
    header = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "Mon, 01 Jan 2024 00:01:30 GMT").otherwise("soon")
    return table(spark, sf, "customer").select("c_custkey", I.retry_delay(header, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("delay"))
