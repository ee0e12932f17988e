"""Runs, windows, reports, sections and the ledger."""

import datetime as dt

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loamgraph.operators import schedule as K
from loamgraph.operators import sections as D
from loamgraph.operators import windows as W
from loamgraph.streaming import pages as G
from loamgraph.streaming import progress as P
from loamgraph.streaming import publish as U
from loamgraph.streaming import runs as Q

EVENTS = "project long, run long, ts timestamp, event_id long, kind string, stage string, step long, total long, resource string, message string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def stream_of(spark, path, *batches, schema):
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / "in" / f"b{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in" / "*"))


def event(ord, kind, stage=None, step=None, total=None, resource=None, message=None, *, run=1, project=1):
    return (project, run, dt.datetime(2024, 1, 1, 0, ord // 60, ord % 60), ord, kind, stage, step, total, resource, message)


def test_a_failure_settles_all_stages(spark, tmp_path):
    first = [
        event(1, "set", "ocr", None, 3, "chapter-3.pdf"), event(2, "set", "clean", 1, 3, "chapter-1.pdf"), event(3, "set", "cut", None, 3, "chapter-1.pdf"),
        event(4, "fail", "ocr", resource="chapter-2.pdf", message="invalid"), event(1, "set", "link", 1, 3, "node-2", project=2), event(1, "set", "cluster", 1, 2, "cluster-2", project=3),
        event(1, "set", "cut", 4, 2, project=4), event(2, "advance", "embed", project=4),
    ]
    late = [
        event(5, "set", "ocr", resource="chapter-3.pdf"), event(6, "advance", "clean"), event(7, "complete", "cut"), event(8, "fail"), event(2, "stop", project=2), event(3, "advance", "link", project=2),
        event(2, "fail", message="provider", project=3), event(9, "fail", "cut", run=0, project=4), event(9, "what", "cut", project=4), (4, None, None, 1, "fail", "cut", None, None, None, None),
    ]
    got = Q.run_states(stream_of(spark, tmp_path, first, late, schema=EVENTS))
    assert rows(got, "project", "stage", "phase", "done", "total", "status", "active", "n_errors") == [
        (1, "clean", "failed", 1, 3, "partial", "", 1), (1, "cut", "failed", 0, 3, "pending", "", 1), (1, "ocr", "failed", 0, 3, "failed", "chapter-2.pdf", 1),
        (2, "link", "stopped", 1, 3, "partial", "", 0), (3, "cluster", "failed", 1, 2, "failed", "cluster-2", 1),
        (4, "cut", "running", 2, 2, "running", "", 0), (4, "embed", "running", 1, 0, "running", "", 0),
    ]


def test_a_later_run_keeps_counts_and_complete_stages(spark, tmp_path):
    first = [event(1, "set", "ocr", 1, 2, "a"), event(2, "advance", "ocr"), event(3, "set", "cut", 1, 4, "a"), event(4, "fail", "cut", resource="a", message="m"), event(5, "fail", "cut", resource="a", message="m")]
    late = [event(6, "advance", "cut", 2, run=2), event(7, "fail", "ocr", run=1), event(8, "end", run=2), event(9, "advance", "cut", run=2)]
    got = Q.run_states(stream_of(spark, tmp_path, first, late, schema=EVENTS))
    assert rows(got, "stage", "run", "phase", "done", "total", "status", "n_errors") == [("cut", 2, "complete", 3, 4, "running", 0), ("ocr", 2, "complete", 2, 2, "complete", 0)]


def test_idle_runs_are_stopped_and_forgotten(spark, tmp_path):
    batches = [[event(1, "set", "ocr", 1, 9, "a")], [event(400, "set", "ocr", 0, 9, "b", project=2)], [event(800, "advance", "ocr", project=2)], [event(2, "advance", "ocr")]]
    stream = stream_of(spark, tmp_path, *batches, schema=EVENTS).withWatermark("ts", "10 seconds")
    got = Q.run_states(stream, idle_ms=100_000)
    assert rows(got, "project", "phase", "done", "status")[0] == (1, "stopped", 1, "partial")


def test_no_events_give_no_states(spark, tmp_path):
    assert Q.run_states(stream_of(spark, tmp_path, [], schema=EVENTS)).count() == 0


def test_windows_are_halved_until_they_fit(spark):
    windows = spark.createDataFrame([(1, 1, 8), (1, 1, 8), (2, 1, 3), (3, 5, 4), (None, 1, 9)], "source_id long, start_line int, end_line int")
    long_lines = spark.createDataFrame([(1, 2), (1, 7)], "source_id long, line_no long")

    def truncated(asked):
        return asked.join(long_lines, "source_id").where("line_no between start_line and end_line").select("source_id", "start_line", "end_line")

    got = W.halved_windows(windows, truncated, smallest=2)
    assert rows(got) == [(1, 1, 2, "unchanged"), (1, 3, 4, "cleaned"), (1, 5, 6, "cleaned"), (1, 7, 8, "unchanged"), (2, 1, 3, "cleaned")]
    lines = spark.createDataFrame([(1, k, [" a ", "", "c", None][k % 4]) for k in range(1, 9)] + [(2, k, "") for k in (1, 2, 3)], "source_id long, line_no int, line string")
    gone = lines.where("line_no in (2, 7)").select("source_id", "line_no")
    assert rows(W.window_texts(got, lines, gone)) == [(1, "c\na\nc\na"), (2, "")]
    assert W.halved_windows(windows.limit(0), truncated).count() == 0
    odd = W.halved_windows(windows.selectExpr("2L as source_id", "1 as start_line", "5 as end_line").limit(1), lambda asked: asked, smallest=1)
    assert [r[1:3] for r in rows(odd)] == [(k, k) for k in range(1, 6)]


def test_reports_repeat_as_far_as_blocks_match(spark):
    rnd = random.Random(5)
    words = "the force of a body is its mass times what it gains in speed".split()
    said = [(1, k, " ".join(rnd.choice(words[:3]) if rnd.random() < 0.1 else w for w in words)) for k in range(60)]
    said += [(2, 0, "# Bottleneck Report\nStraße, 1!"), (2, 1, "STRASSE 1"), (2, 2, None), (2, 3, None), (2, 4, "..."), (2, 5, "x"), (2, 6, "x"), (3, 0, "ab" * 300), (3, 1, "ab" * 299 + "cc")]
    df = spark.createDataFrame(said, "id long, ord long, text string").withColumn("count", F.lit(0))
    got = {(r["id"], r["ord"]): r for r in K.repeated_reports(df, key="id", order=["ord"]).collect()}

    def bare(t):
        return re.sub(r"[\W_]+", "", re.sub(r"(?im)^\s*#*\s*bottleneck report\s*$", "", t or "").casefold())

    before = {}
    for key, k, text in said:
        old, n = before.get(key, ("", 0))
        a, b = bare(old), bare(text)
        n = n + 1 if a and b and (a == b or SequenceMatcher(None, a, b).ratio() >= 0.88) else 1
        before[key] = (text, n)
        row = got[(key, k)]
        assert row["repeat_count"] == n and row["history"] == [t or "" for i, j, t in said if i == key and k - 20 < j <= k] and row["count"] == 0
    assert {got[(1, k)]["repeat_count"] > 1 for k in range(60)} == {True, False}
    assert K.repeated_reports(df.limit(0), key="id", order=["ord"]).count() == 0


def test_texts_are_tables_of_sections(spark):
    text = "# T\n\nx\n## a \n1\n### b\n2\n##c\n\n##  d"
    got = D.sections(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "## e\n\n y \n")], "doc long, text string"))
    assert rows(got) == [(1, 0, "", "# T\n\nx"), (1, 1, "a", "1\n### b\n2\n##c"), (1, 2, "d", ""), (2, 0, "", ""), (4, 0, "", ""), (4, 1, "e", "y")]


def value(spark, f, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{k} string" for k in range(len(texts))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(texts))])).first()[0]


def test_drafts_can_be_formatted_again(spark):
    head, trace = "# 001. T\n\n## 先修前置\n\n- p", "## 来源追溯\n\n- new"
    want = head + "\n\n## 学习目标\n\n**学习目标**：g\n\n## 正文\nbody\n\n### 来源\nz\n\n" + trace + "\n"
    raw = "---\nx: 1\n---\n# Old\n\n## 学习目标与先修前置\n先修知识：k\n**学习目标**：g\n\n## 正文\nbody\n\n### 来源\nz\n\n## 来源追溯\n\n- old\n\n## 附\nmore"
    once = value(spark, D.formatted_draft, head, raw, trace)
    assert once == want and value(spark, D.formatted_draft, head, once, trace) == want
    assert value(spark, D.formatted_draft, head, "# Only\n\n## 先修前置\n\n- p", None) == head + "\n\n\n"
    assert value(spark, D.formatted_draft, head, None, "") == head + "\n\n\n" and value(spark, D.formatted_draft, None, "x", "") is None
    assert value(spark, D.goal_text, "学习目标：a\n先修前置: b") == "学习目标：a" and value(spark, D.goal_text, "x。学习完成后 y") == "学习完成后 y" and value(spark, D.goal_text, "z") == "z"
    assert value(spark, D.without_trace, "a\n\n## 来源追溯") == "a\n\n## 来源追溯"  # a heading needs a line of its own that ends


def test_revisions_keep_what_the_program_wrote(spark):
    now = "# T\n\n## 先修前置\n\n- p\n\n## 正文\nold\n\n## 来源追溯\n\n- s\n\n## 附\nmore\n"
    new = "# Other\n\n## 先修前置\nnone\n\n## 正文\nnew\n\n## 先修前置\nagain\n\n## 例\ne\n\n## 来源追溯\n- wrong\n## 后\nlost"
    assert value(spark, D.restored, now, new) == "# T\n\n## 先修前置\n\n- p\n\n## 正文\nnew\n\n## 例\ne\n\n## 来源追溯\n\n- s\n\n## 附\nmore\n"
    assert value(spark, D.restored, "plain", "# X\n\nbody") == "body\n" and value(spark, D.restored, None, None) == "\n"


def test_deltas_and_compaction_give_one_ledger(spark, tmp_path):
    schema = "record string, node_ids array<string>, output_path string"
    path = str(tmp_path / "ledger")
    put = lambda n, *some: U.add_records(spark.createDataFrame(some, schema), path, n)
    assert U.read_ledger(spark, path, schema).count() == 0 and U.compact_ledger(spark, path, schema) == -1
    put(0, ("r1", ["n1"], "a"), ("r2", ["n2", "n9"], "b"), ("r0", [], "z"))
    put(1, ("r3", ["n2", "n3"], "c"))
    want = [("r0", "z"), ("r1", "a"), ("r3", "c")]
    assert rows(U.read_ledger(spark, path, schema), "record", "output_path") == want
    assert U.compact_ledger(spark, path, schema) == 1
    assert rows(U.read_ledger(spark, path, schema), "record", "output_path") == want
    put(2, ("r1", ["n1"], "new"))
    put(2, ("r1", ["n1"], "newer"), ("r4", ["n9"], "d"))  # a batch written again
    (tmp_path / "ledger" / "delta" / "batch=3").mkdir()  # one that failed half-way
    want = [("r0", "z"), ("r1", "newer"), ("r3", "c"), ("r4", "d")]
    assert rows(U.read_ledger(spark, path, schema), "record", "output_path") == want
    assert U.compact_ledger(spark, path, schema) == 2 and rows(U.read_ledger(spark, path, schema), "record", "output_path") == want


def test_pages_add_up_whatever_order_ranges_report_in(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    planned, said = "file long, chunk int, pages long, file_pages long, planned_at timestamp", "file long, chunk int, ts timestamp, event_id string, done long, text string"
    ranges = [(1, 1, 99, 165, at(1)), (1, 2, 66, 165, at(1)), (2, 1, 5, 5, at(3))]
    first = [(1, 2, at(2), "a", 62, None), (1, 1, at(3), "b", 20, " "), (1, 2, at(4), "c", 8, "late"), (9, 1, at(4), "x", 1, "unplanned"), (2, 1, at(2), "y", 5, "before it was planned")]
    late = [(1, 1, at(5), "d", 120, "one"), (1, 2, at(6), "e", 66, "two"), (1, None, at(6), "z", 1, "none"), (2, 1, at(7), "w", None, "")]
    plan = stream_of(spark, tmp_path / "plan", ranges, schema=planned)
    matched = G.kept_reports(G.reported(plan, stream_of(spark, tmp_path / "said", first, late, schema=said)))
    assert [r["done"] for r in G.file_progress(matched).where("file = 1").orderBy("ts").collect()] == [62, 82, 82, 161, 165]
    got = G.whole_files(spark.createDataFrame(ranges, planned), matched)
    assert sorted(map(tuple, got.collect())) == [(1, 2, [], "one\n\ntwo"), (2, 1, [1], None)]
    none = G.whole_files(spark.createDataFrame(ranges, planned), matched.limit(0))
    assert sorted((r["file"], r["missing"]) for r in none.collect()) == [(1, [1, 2]), (2, [1])] and G.file_progress(matched.limit(0)).count() == 0


def test_pages_are_held_in_tables_between_batches(spark, tmp_path):
    at = lambda d, m=0: dt.datetime(2024, 1, d, 0, m)
    planned, said = "file long, chunk int, pages long, file_pages long, planned_at timestamp", "file long, chunk int, ts timestamp, event_id string, done long, text string"
    ranges = [[(1, 1, 9, 9, at(1))], [(2, 1, 5, 5, at(1)), (3, None, 5, 5, at(1)), (4, 1, 5, 5, None)], [(5, 1, 7, 7, at(3))]]
    reports = [[(2, 1, at(1, 9), "early", 4, "before its plan came")], [(1, 1, at(2), "a", 3, None), (4, 1, at(2), "z", 1, "never planned")], [(1, 1, at(9), "b", 9, "after the horizon"), (5, 1, at(3, 5), "c", 99, "x"), (2, 1, at(2), "d", 5, "y")]]
    folders = [str(tmp_path / "plan"), str(tmp_path / "said")]
    for k in range(3):  # a batch for each
        spark.createDataFrame(ranges[k], planned).coalesce(1).write.mode("append").parquet(folders[0])
        spark.createDataFrame(reports[k], said).coalesce(1).write.mode("append").parquet(folders[1])
    plan, stream = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f) for s, f in zip((planned, said), folders))
    both = G.reported(plan, stream, delay="3 days")
    matched = G.kept_reports(both)
    assert sorted((r["file"], r["event_id"], r["done"]) for r in matched.collect()) == [(1, "a", 3), (2, "d", 5), (2, "early", 4), (5, "c", 7)]
    assert len({f.split("batch=")[1].split("/")[0] for f in matched.inputFiles()}) == 3 and "Join" not in both._jdf.queryExecution().toString()  # no state of a join


def test_progress_is_folded_by_windows_as_step_by_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "WHOLE", 2)
    pick, schema = random.Random(5), "project long, stage string, run long, ts timestamp, event_id long, step int, total int, failed boolean"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(pick.choice((1, 2, None)), pick.choice("ab"), pick.choice((1, 1, 2, 3, None)) if b else pick.choice((0, 1)), at(pick.randrange(20)), 100 * b + k, pick.choice((0, 1, 3, -1)), pick.choice((0, 1, 2)), pick.choice((None, False, False, True) if k % 4 == 0 else (False,))) for k in range(40)] for b in range(5)]
    batches[4] += [(3, None, 1, at(1), 900, None, 2, None), (3, None, -5, at(0), 901, 1, 1, True)]  # a null step is none, a run before the first is late
    want = {}
    for batch in batches:
        for project, stage, run, _, _, step, more, failed in sorted(batch, key=lambda e: (e[3], e[4])):
            now, done, total, status = want.setdefault((project, stage), (-1, 0, 0, "pending"))
            if run is not None and run < now:
                continue
            if run is not None and run > now:
                now, status = run, "pending" if status == "failed" else status
            if status != "failed":
                total += more or 0
                done = min(done + (step or 0), total)
                status = "failed" if failed else "complete" if total and done >= total else "running" if done else "pending"
            want[project, stage] = (now, done, total, status)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = P.latest_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert {(r["project"], r["stage"]): (r["run"], r["done"], r["total"], r["status"]) for r in got.collect()} == want
    plan = P.advanced(spark.createDataFrame(batches[0], schema))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan  # no call of Python for each stage


def test_a_step_of_a_draft_cuts_its_text_once(spark):
    df = spark.createDataFrame([("# T\n\n## 先修前置\n\n- p\n\n## 正文\nx\u3000",), ("---\na: b\n---\n# T\n\nbody",), (None,)], "t string")
    step = df.select(D.without_preamble(F.col("t")).alias("t"), D.T.strip_front_matter(F.col("t")).alias("u"))
    assert [r["t"] for r in step.collect()] == ["## 正文\nx", "---\na: b\n---\n# T\n\nbody", None] and [r["u"] for r in step.collect()][1] == "# T\n\nbody"
    plan = step._jdf.queryExecution().optimizedPlan().toString()
    assert r"(?U)^\s+" not in plan  # the pattern that all steps stripped texts by


def test_drafts_are_formatted_without_cutting_them_into_pieces(spark):
    many = "# T\n" + "\n## 先修前置\n\n- p\n" * 5000 + "\n##  先修前置 again\nq\n\n## 先修前置x\nkept"
    cases = [
        (many, "## 先修前置x\nkept"), ("# T\n\n##\n　先修前置\nx\n## 来源追溯\nold", ""), ("# T\n## 先修前置\n## 来源追溯\n", "## 来源追溯"), ("# T\n来源追溯\n\n##\t来源追溯 　\n- old", "# T\n来源追溯"),
        ("## 学习目标与先修前置\n## 来源追溯\nx", ""), ("##\n\n学习目标与先修前置\n学习目标：g\n先修：k\n## y\nz", "## 学习目标\n\n学习目标：g\n\n## y\nz"), ("x\n##" + " " * 100000 + "来源追溯", "x\n##" + " " * 100000 + "来源追溯"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    out = df.select("k", D.without_trace(D.normal_learning(D.without_preamble(F.col("t")))).alias("t"), D.formatted_draft(F.lit(""), F.col("t"), F.lit(None).cast("string")).alias("u"))
    got = {r["k"]: r for r in out.collect()}
    assert [got[k]["t"] for k in range(len(cases))] == [want for _, want in cases]
    assert got[3]["u"] == "\n\n来源追溯\n" and all(got[k]["u"] == f"\n\n{cases[k][1]}\n" for k in (0, 2, 4, 5, 6))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert r"(?=^##\s)" not in plan and "btrim" not in plan  # the cut of all sections, and the trim that walks over all of a text


def test_long_texts_are_stripped_at_their_ends(spark):
    ends = ["", "\n", " 　\x85", " " * 20, "\n" + "　" * 20, "　" * 21, " \n" * 31, " " * 64, "\xa0" * 500]
    texts = [a + x + b for a in ("", "　\n") for x in ("", "x", "溯", "追溯", "𝒳", "é" * 50) for b in ends]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [(r["t"], r["s"]) for r in df.select("t", D.T.strip_long(F.col("t")).alias("s")).collect()] == [(t, t.strip()) for t in texts] + [(None, None)]
