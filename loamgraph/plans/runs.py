"""Queries of runs: their stages, windows that were cut short, repeated reports, drafts by sections, and the ledger of what was published."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgraph.operators import lines as L
from loamgraph.operators import schedule as K
from loamgraph.operators import sections as D
from loamgraph.operators import windows as W
from loamgraph.plans.registry import query
from loamgraph.sources.stages import new_path, table
from loamgraph.streaming import pages as G
from loamgraph.streaming import publish as U
from loamgraph.streaming import runs as Q

# Runs: a user is a project, the kinds of events are stages


@query("""WITH e AS (SELECT user_id AS project, event_type AS stage, 1 + event_id // 20 % 4 AS run, event_id, 'r' || event_id % 3 AS resource, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
  CASE WHEN event_id % 29 = 0 THEN 'fail' WHEN event_id % 31 = 0 THEN 'stop' WHEN event_id % 7 = 0 THEN 'complete' ELSE 'advance' END AS kind FROM events),
k AS (SELECT *, max(run) OVER (PARTITION BY project ORDER BY ord) AS latest, max(run) OVER (PARTITION BY project) AS final FROM e),
t AS (SELECT *, coalesce(bool_or(kind IN ('fail', 'stop')) OVER (PARTITION BY project, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM k WHERE run = latest),
a AS (SELECT * FROM t WHERE kind = 'fail' OR NOT over),
p AS (SELECT project, max(final) AS run, CASE WHEN bool_or(kind = 'fail' AND run = final) THEN 'failed' WHEN bool_or(kind = 'stop' AND run = final) THEN 'stopped' ELSE 'running' END AS phase,
  count(DISTINCT (stage, resource)) FILTER (kind = 'fail' AND run = final)::INTEGER AS n_errors FROM a GROUP BY project),
s AS (SELECT project, stage, count(*) FILTER (kind = 'advance')::BIGINT AS done, arg_max(kind, ord) FILTER (kind IN ('fail', 'complete')) AS last, arg_max(resource, ord) FILTER (kind = 'fail') AS resource,
  arg_max(run, ord) FILTER (kind IN ('fail', 'complete')) AS last_run, coalesce(bool_or(kind = 'advance' AND run = final), false) AS moved FROM a WHERE kind <> 'stop' GROUP BY ALL),
r AS (SELECT project::BIGINT AS project, stage, run::BIGINT AS run, phase, done, 0::BIGINT AS total, n_errors, resource, CASE WHEN last = 'complete' THEN 'complete' WHEN last = 'fail' AND last_run = run THEN 'failed' WHEN NOT moved THEN 'pending' WHEN phase = 'running' THEN 'running' ELSE 'partial' END AS status
  FROM s JOIN p USING (project))
SELECT project, stage, run, phase, done, total, status, CASE WHEN status = 'failed' THEN resource ELSE '' END AS active, n_errors FROM r""")
def stream_run_states(spark, sf):
    n, none = F.col("event_id"), F.lit(None)
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    kind = F.when(n % 29 == 0, "fail").when(n % 31 == 0, "stop").when(n % 7 == 0, "complete").otherwise("advance")
    return Q.run_states(stream.select(
        F.col("user_id").cast("long").alias("project"), F.expr("cast(1 + event_id div 20 % 4 as long)").alias("run"), "ts", "event_id", kind.alias("kind"), F.col("event_type").alias("stage"),
        F.lit(1).cast("long").alias("step"), none.cast("long").alias("total"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("resource"), F.lit("").alias("message"),
    ))


# Windows: a reply about a window is cut short if its lines are longer than it may be; every third line is deleted


_WINDOWS = """lines AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
total AS (SELECT source_id, line_no, line, sum(length(line)) OVER (PARTITION BY source_id ORDER BY line_no)::BIGINT AS total FROM lines),
w(source_id, s, e, cost) AS (
  SELECT source_id, 1::BIGINT, max(line_no)::BIGINT, max(total) FROM total GROUP BY source_id
  UNION ALL SELECT h.source_id, h.s, h.e, b.total - coalesce(a.total, 0) FROM (
    SELECT source_id, unnest([s, s + (e - s + 1) // 2]) AS s, unnest([s + (e - s + 1) // 2 - 1, e]) AS e FROM w WHERE cost > 400 AND e - s + 1 > 3) h
  JOIN total b ON b.source_id = h.source_id AND b.line_no = h.e LEFT JOIN total a ON a.source_id = h.source_id AND a.line_no = h.s - 1),
done AS (SELECT source_id, s AS start_line, e AS end_line, CASE WHEN cost > 400 THEN 'unchanged' ELSE 'cleaned' END AS outcome FROM w WHERE cost <= 400 OR e - s + 1 <= 3)"""


def _halved(spark, sf):
    lines = L.document_lines(table(spark, sf, "documents"))
    up_to = Window.partitionBy("source_id").orderBy("line_no")
    running = lines.select("source_id", "line_no", F.sum(F.length("line")).over(up_to).alias("total"))
    whole = lines.groupBy("source_id").agg(F.lit(1).alias("start_line"), F.max("line_no").alias("end_line"))
    return lines, W.halved_windows(whole, lambda asked: W.window_costs(asked, running).where("cost > 400"), smallest=3)


@query(f"WITH RECURSIVE {_WINDOWS} SELECT source_id, start_line, end_line, outcome FROM done")
def halved_windows(spark, sf):
    return _halved(spark, sf)[1]


@query(rf"""WITH RECURSIVE {_WINDOWS},
part AS (SELECT d.source_id, d.start_line, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (outcome <> 'cleaned' OR line_no % 3 <> 0), '^\s+|\s+$', '', 'g'), '') AS text
  FROM done d JOIN lines l ON l.source_id = d.source_id AND l.line_no BETWEEN d.start_line AND d.end_line GROUP BY ALL)
SELECT source_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY start_line) FILTER (text <> ''), '')) AS text_sha256 FROM part GROUP BY source_id""")
def halved_window_texts(spark, sf):
    lines, settled = _halved(spark, sf)
    return W.window_texts(settled, lines, lines.where("line_no % 3 = 0")).select("source_id", F.sha2("text", 256).alias("text_sha256"))


# Reports: the turns of a conversation, said again with other case and marks


@query()
def repeated_reports(spark, sf):
    """No SQL: the share of matching blocks. Tests hold it against the library of sequences that defines it."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), "text")
    report = F.when(F.col("again") == 1, F.concat(F.lit("## Bottleneck report\n"), F.upper("text"), F.lit(" !"))).otherwise(F.col("text"))
    rows = K.repeated_reports(said.withColumn("text", report), key="conv_id", order=["turn", "again"])
    return rows.select("conv_id", "turn", "again", "repeat_count", F.size("history").alias("n_history"), F.sha2(F.array_join("history", "\n"), 256).alias("history_sha256"))


# Drafts: documents with the sections that a program puts around them


_DRAFTS = """x AS (SELECT doc_id AS node, '# ' || source || chr(10) || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '## 先修前置' || chr(10) || chr(10) || '- p' || doc_id % 7 || chr(10) || chr(10) ELSE '' END AS head,
  CASE WHEN doc_id % 2 = 0 THEN '## 学习目标与先修前置' || chr(10) || '先修知识：k' || chr(10) || '学习目标：g' || doc_id % 5 || chr(10) || chr(10) ELSE '' END AS goal,
  '## 正文' || chr(10) || trim(replace(regexp_replace(text, '[^a-z ]', '', 'g'), '  ', ' ')) || '.' AS main, CASE WHEN doc_id % 5 > 0 THEN chr(10) || chr(10) || '## 来源追溯' || chr(10) || chr(10) || '- old' || chr(10) || chr(10) || '## 附' || chr(10) || 'more' ELSE '' END AS tail FROM documents)"""


def _drafts(spark, sf):
    n, text = F.col("doc_id"), F.trim(F.replace(F.regexp_replace("text", "[^a-z ]", ""), F.lit("  "), F.lit(" ")))
    put = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise("")
    return table(spark, sf, "documents").select(
        n.alias("node"), F.concat(F.lit("# "), "source", F.lit("\n\n"), put(n % 3 > 0, "## 先修前置\n\n- p", n % 7, "\n\n")).alias("head"),
        put(n % 2 == 0, "## 学习目标与先修前置\n先修知识：k\n学习目标：g", n % 5, "\n\n").alias("goal"), F.concat(F.lit("## 正文\n"), text, F.lit(".")).alias("main"),
        put(n % 5 > 0, "\n\n## 来源追溯\n\n- old\n\n## 附\nmore").alias("tail"),
    )


@query(f"""WITH {_DRAFTS} SELECT node, '# new' || chr(10) || chr(10) || '## 先修前置' || chr(10) || chr(10) || '- q' || chr(10) || chr(10) ||
  CASE WHEN node % 2 = 0 THEN '## 学习目标' || chr(10) || chr(10) || '学习目标：g' || node % 5 || chr(10) || chr(10) ELSE '' END || main || chr(10) ||
  CASE WHEN node % 4 > 0 THEN chr(10) || '## 来源追溯' || chr(10) || chr(10) || '- t' || node % 4 || chr(10) ELSE '' END AS text FROM x""")
def drafts(spark, sf):
    x = _drafts(spark, sf)
    preambles = x.select("node", F.lit("# new\n\n## 先修前置\n\n- q").alias("preamble"))
    traces = x.where("node % 4 > 0").select("node", F.concat(F.lit("## 来源追溯\n\n- t"), (F.col("node") % 4).cast("string")).alias("trace"))
    once = D.drafts(preambles, x.select("node", F.concat("head", "goal", "main", "tail").alias("text")), traces)
    return D.drafts(preambles, once, traces)  # drafts of drafts are the same drafts


@query(f"""WITH {_DRAFTS} SELECT node, '# ' || split_part(substr(head, 3), chr(10), 1) || chr(10) || chr(10) || CASE WHEN node % 3 > 0 THEN '## 先修前置' || chr(10) || chr(10) || '- p' || node % 7 || chr(10) || chr(10) ELSE '' END ||
  '## 改写' || chr(10) || upper(rtrim(main[7:40])) || tail || chr(10) AS text FROM x""")
def restored_sections(spark, sf):
    x = _drafts(spark, sf)
    revised = F.concat(F.lit("# other\n\n## 先修前置\n\nnone\n\n## 改写\n"), F.upper(F.substring("main", 7, 34)), F.lit("\n\n## 来源追溯\n\n- wrong\n"))
    return x.select("node", D.restored(F.concat("head", "goal", "main", "tail"), revised).alias("text"))


@query("""WITH s AS (SELECT doc_id, string_split(chr(10) || text, chr(10) || '## ') AS p FROM documents),
f AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS ord FROM s)
SELECT doc_id, ord::INTEGER AS ord, CASE WHEN ord = 0 THEN '' ELSE trim(split_part(piece, chr(10), 1)) END AS heading,
  sha256(trim(CASE WHEN ord = 0 THEN piece WHEN contains(piece, chr(10)) THEN substr(piece, strpos(piece, chr(10)) + 1) ELSE '' END, ' ' || chr(9) || chr(10) || chr(13))) AS body_sha256 FROM f""")
def document_sections(spark, sf):
    return D.sections(table(spark, sf, "documents").select("doc_id", "text"), key="doc_id").select("doc_id", "ord", "heading", F.sha2("body", 256).alias("body_sha256"))


# The ledger: orders are records of their customer and of the next one, in batches by year


@query("""WITH r AS (SELECT o_orderkey AS record, o_custkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS b, year(o_orderdate) AS batch FROM orders),
n AS (SELECT batch, a AS node FROM r UNION SELECT batch, b FROM r), m AS (SELECT node, max(batch) AS last FROM n GROUP BY node)
SELECT r.record, r.a, r.b FROM r JOIN m x ON x.node = r.a JOIN m y ON y.node = r.b WHERE x.last <= r.batch AND y.last <= r.batch""")
def ledger_deltas(spark, sf):
    o = table(spark, sf, "orders")
    c = F.col("o_custkey").cast("long")
    records = o.select(F.col("o_orderkey").cast("long").alias("record"), F.array(c, F.when(F.col("o_orderkey") % 3 == 0, c + 1).otherwise(c)).alias("node_ids"), F.year("o_orderdate").alias("year"))
    path, schema = new_path(spark, "ledger"), "record long, node_ids array<long>"
    years = [r[0] for r in records.select("year").distinct().orderBy("year").collect()]
    for k, year in enumerate(years):
        U.add_records(records.where(F.col("year") == year).drop("year"), path, year)
        if k == len(years) // 2:
            U.compact_ledger(spark, path, schema)
    if years:  # the last batch once more, as after a failure
        U.add_records(records.where(F.col("year") == years[-1]).drop("year"), path, years[-1])
    return U.read_ledger(spark, path, schema).select("record", F.col("node_ids")[0].alias("a"), F.col("node_ids")[1].alias("b"))


# Pages: an order is a file whose page ranges are planned when it is placed; its parts' shipping is what jobs report


_PAGES = """f AS (SELECT o_orderkey::BIGINT AS file, (1 + o_orderkey * 37 % 250)::BIGINT AS file_pages, o_orderdate::TIMESTAMP AS planned_at FROM orders),
plan AS (SELECT file, file_pages, planned_at, unnest(range(1, (file_pages + 98) // 99 + 1)) AS chunk FROM f),
ranges AS (SELECT *, least(99, file_pages - 99 * (chunk - 1)) AS pages FROM plan),
said AS (SELECT l_orderkey::BIGINT AS file, 1 + l_linenumber % 3 AS chunk, l_shipdate::TIMESTAMP AS ts, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS event_id, l_quantity::BIGINT * 3 AS done, CASE WHEN l_returnflag <> 'N' THEN 't' || l_partkey ELSE ' ' END AS text FROM lineitem),
m AS (SELECT r.file, r.chunk, file_pages, ts, event_id, text, least(done, pages) AS done FROM ranges r JOIN said s ON s.file = r.file AND s.chunk = r.chunk AND ts >= planned_at AND ts <= planned_at + INTERVAL 400 DAY)"""


def _pages(spark, sf):
    """The plan as a table, and the reports that the streams' join keeps."""

    def read(name, stream):
        return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*") if stream else table(spark, sf, name)

    def plan(stream):
        files = read("orders", stream).select(F.col("o_orderkey").cast("long").alias("path"), (1 + F.col("o_orderkey") * 37 % 250).alias("pages"), F.col("o_orderdate").cast("timestamp").alias("planned_at"))
        rows = files.select("path", "planned_at", F.col("pages").cast("long").alias("file_pages"), F.posexplode(F.sequence(F.lit(1), F.col("pages").cast("int"), F.lit(99))).alias("k", "first"))
        pages = F.least(F.lit(99), F.col("file_pages") - F.col("first") + 1).cast("long")
        return rows.select(F.col("path").alias("file"), (F.col("k") + 1).alias("chunk"), pages.alias("pages"), "file_pages", "planned_at")

    reports = read("lineitem", True).select(
        F.col("l_orderkey").cast("long").alias("file"), (1 + F.col("l_linenumber") % 3).cast("int").alias("chunk"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_id"),
        (F.col("l_quantity").cast("long") * 3).alias("done"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).otherwise(" ").alias("text"),
    )
    return plan(False), G.kept_reports(G.reported(plan(True), reports, delay="4000 days", horizon="400 days"))


@query(f"""WITH {_PAGES}, d AS (SELECT *, greatest(done - coalesce(max(done) OVER (PARTITION BY file, chunk ORDER BY ts, event_id, done ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS more FROM m)
SELECT file, ts::DATE AS day, event_id, least(sum(more) OVER (PARTITION BY file ORDER BY ts, event_id), file_pages)::BIGINT AS done FROM d""")
def stream_page_progress(spark, sf):
    return G.file_progress(_pages(spark, sf)[1]).select("file", F.to_date("ts").alias("day"), "event_id", "done")


@query(f"""WITH {_PAGES}, t AS (SELECT file, chunk, arg_max(text, (ts, event_id, text)) AS text FROM m WHERE trim(text) <> '' GROUP BY ALL)
SELECT r.file, count(*) AS chunks, coalesce(string_agg(r.chunk::VARCHAR, ',' ORDER BY r.chunk) FILTER (text IS NULL), '') AS missing, CASE WHEN count(text) = count(*) THEN string_agg(text, chr(10) || chr(10) ORDER BY r.chunk) END AS text
FROM ranges r LEFT JOIN t ON t.file = r.file AND t.chunk = r.chunk GROUP BY r.file""")
def stream_whole_files(spark, sf):
    return G.whole_files(*_pages(spark, sf)).withColumn("missing", F.array_join("missing", ","))
