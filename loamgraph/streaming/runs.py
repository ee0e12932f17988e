"""Runs of many stages as one keyed streaming state: a failure or a stop of one stage settles all others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loamgraph.sources.stages import new_path

OUT = "project long, stage string, run long, phase string, done long, total long, status string, active string, n_errors int, version long"
#: Phases in which a run takes no more steps, and how many errors are kept.
TERMINAL = {"complete", "failed", "stopped"}
KEPT_ERRORS = 20
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Run:
    """What is known of one project while a batch is folded into it."""

    def __init__(self, run: int, phase: str, version: int, stages: dict[str, list], errors: list[tuple]):
        self.run, self.phase, self.version, self.stages, self.errors = run, phase, version, stages, errors

    def begin(self, run: int) -> None:
        """A later run: counts and complete stages stay, all else starts anew."""
        self.run, self.phase, self.errors = run, "running", []
        for s in self.stages.values():
            s[2:] = ["complete" if s[2] == "complete" else "pending", ""]

    def settle(self, but: str | None = None) -> None:
        """No stage but ``but`` is running any more."""
        for name, s in self.stages.items():
            if name != but and s[2] == "running":
                s[2:] = ["partial" if s[0] > 0 else "pending", ""]

    def take(self, kind: str, stage: str | None, step: int | None, total: int | None, resource: str, message: str) -> None:
        over = self.phase in TERMINAL
        if kind == "fail":
            if stage is None:  # the last of the stages that run, of a run that isn't over
                if over:
                    return
                running = sorted(n for n, s in self.stages.items() if s[2] == "running")
                stage = running[-1] if running else "pipeline"
                resource = self.stages[stage][3] if running else ""
            if stage != "pipeline":
                self.stages.setdefault(stage, [0, 0, "pending", ""])[2:] = ["failed", resource]
            self.settle(stage)
            error = (stage, resource, message)
            self.errors = [e for e in self.errors if e != error][1 - KEPT_ERRORS :] + [error]
            self.phase = "failed"
            return
        if over:
            return
        if kind in ("stop", "end"):
            if kind == "stop":
                self.settle()
            self.phase = "stopped" if kind == "stop" else "complete"
            return
        if stage is None:
            return
        s = self.stages.setdefault(stage, [0, 0, "pending", ""])
        if kind == "set":
            s[1] = s[1] if total is None else max(0, total)
            s[0] = s[0] if step is None else max(0, step)
            s[0] = min(s[0], s[1]) if s[1] else s[0]
            s[2:] = ["running", resource]
        elif kind == "advance":
            done = s[0] + (1 if step is None else step)
            s[0] = min(done, s[1]) if s[1] else max(0, done)
            if s[1] and s[0] >= s[1]:
                s[2:] = ["complete", ""]
            elif s[2] == "pending":
                s[2] = "running"
        elif kind == "complete":
            s[0] = s[1] or s[0]
            s[2:] = ["complete", ""]

    def rows(self, project: int) -> pd.DataFrame:
        head = (self.run, self.phase)
        out = [(project, name, *head, *s, len(self.errors), self.version) for name, s in sorted(self.stages.items())]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


class RunProcessor(StatefulProcessor):
    """A project's run as a value, its stages as a map, its errors as a list; with ``idle_ms``, a timer for runs that nothing is heard of."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "run long, phase string, version long")
        self.stages = handle.getMapState("stages", "stage string", "done long, total long, status string, active string")
        self.errors = handle.getListState("errors", "stage string, resource string, message string")

    def _load(self) -> Run:
        if not self.head.exists():
            return Run(-1, "running", 0, {}, [])
        run, phase, version = self.head.get()
        return Run(run, phase, version, {k[0]: list(v) for k, v in self.stages.iterator()}, [tuple(e) for e in self.errors.get()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("run", "kind", "stage", "step", "total", "resource", "message")]
        for run, kind, stage, step, total, resource, message in zip(*columns):
            if run is None or kind is None or run < state.run:
                continue
            if run > state.run:
                state.begin(int(run))
            state.take(kind, stage, None if step is None else int(step), None if total is None else int(total), resource or "", message or "")
        state.version += 1
        self.head.update((int(state.run), state.phase, state.version))
        for name, s in state.stages.items():
            self.stages.updateValue((name,), (int(s[0]), int(s[1]), s[2], s[3]))
        if state.errors:
            self.errors.put(state.errors)
        else:
            self.errors.clear()
        if self.idle_ms is not None and len(batch):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(batch["ts"].max().value // 1_000_000) + self.idle_ms)
        yield state.rows(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        state.take("stop", None, None, None, "", "")
        state.version += 1
        for s in (self.head, self.stages, self.errors):
            s.clear()
        yield state.rows(key[0])


def run_stream(events: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """A stream ``events(project, run, ts, event_id, kind, stage, step, total, resource, message)`` -> all stages of each project that a batch has events of.

    Kinds: ``set`` (total, done = step, running with ``resource``), ``advance`` (by ``step``, 1 where null), ``complete``, ``fail``, ``stop``, ``end``. Events
    are taken by ts, then event_id. A later run begins with its first event: counts and complete stages stay. Events of earlier runs, and those without a
    run or a kind, go; so do steps of a run that has failed, ended or been stopped. A failure leaves other running stages ``partial``, or ``pending`` where
    nothing is done, and its error stays once, among the last 20; a failure of no stage is that of the last running one (by name), unless the run is
    over. Unknown kinds change nothing. A project with no stage yet gives no rows. A project's events of one batch are folded in one task, so the size of
    batches (``maxFilesPerTrigger``) bounds it.

    With ``idle_ms`` the stream needs a watermark on ``ts``: a project that nothing is heard of for so long is stopped and forgotten, and events behind the watermark go.
    """
    keyed = events.groupBy("project")
    if idle_ms is None:
        return keyed.transformWithStateInPandas(RunProcessor(), OUT, "Update", "None")
    return keyed.transformWithStateInPandas(RunProcessor(idle_ms), OUT, "Update", "EventTime")


def run_states(events: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """Runs ``run_stream`` over what is there, and returns the last rows of each project, without ``version``."""
    spark = events.sparkSession
    out, marks = new_path(spark, "runs"), new_path(spark, "runs-marks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        stream = run_stream(events, idle_ms=idle_ms)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    rows = spark.read.schema(OUT + ", batch long").parquet(out)
    last = Window.partitionBy("project", "stage").orderBy(F.desc("batch"), F.desc("version"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "batch", "version")
