"""Task lifecycles on a stream of appended trace lines (J1, J2, T17): the batch's ``analyze.tasks`` as keyed state.

Several writers append JSON lines to one folder (``sinks.append_events``); the reader takes the files as they come. A task's state is
one typed row: its times, flags and last values, as in the batch. A start begins the task anew; a completion or cancellation without one makes a
stub; a consumption counts once the task is there. After each micro-batch the tasks that it changed are emitted whole, with the number of
changes so far, so the last row of a task is its lifecycle; how the lines fall into micro-batches does not matter as long as those come in the
order of ``t``, and neither does a restart. Events of a task at one ``t`` are taken as start, completion, cancellation, consumption.

``updates`` holds the state in Spark's own aggregates and is what to use for many tasks; its rows need a sink that takes updates (``append_updates``).
``stream`` calls Python for each task of a micro-batch and can close silent tasks. With a timeout, a task whose last event is that far behind the watermark is emitted once more with ``closed`` set and its state is given up; events
later than the watermark are dropped by Spark and belong to no task. Lines without a task_id, of another kind or not parsable make no task;
a null run_id reads ``unknown`` as in the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.traces import parsed_lines

KINDS = ("prefetch_started", "prefetch_completed", "prefetch_cancelled", "resource_consumed")
FIELDS = "task_id string, resource_id string, elapsed_s double, bytes_staged double, wasted boolean, status string"
STATE = "started_t double, resource string, elapsed_s double, completed_t double, measured double, cancelled_t double, wasted boolean, consumed_t double, consumed_step int, status string, last_t double, changes bigint"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
SCHEMA = f"run_id string, task string, {STATE}, closed boolean"


class Lifecycle:
    """One task's state; ``feed`` takes an event."""

    def __init__(self, values: tuple | None = None):
        self.v = dict(zip(_NAMES, values or (None,) * len(_NAMES), strict=True))
        self.v["changes"] = self.v["changes"] or 0

    @property
    def known(self) -> bool:
        return self.v["changes"] > 0

    def feed(self, kind: str, t: float, step: int, resource, elapsed, staged, wasted, status) -> None:
        v = self.v
        if kind == "resource_consumed" and not self.known:
            return
        if kind == "prefetch_started":
            changes = v["changes"]
            self.__init__()
            v = self.v
            v.update(started_t=t, resource=resource or "", changes=changes)
        elif kind == "prefetch_completed":
            v["elapsed_s"] = elapsed or 0.0
            timed = v["started_t"] and v["elapsed_s"] > 0
            v["completed_t"] = v["started_t"] + v["elapsed_s"] if timed else t
            v["measured"] = v["measured"] if staged is None else staged
        elif kind == "prefetch_cancelled":
            v.update(cancelled_t=t, wasted=bool(wasted))
        else:
            v.update(consumed_t=t, consumed_step=step, status=status or "")
        v["last_t"], v["changes"] = t, v["changes"] + 1

    def row(self, run_id: str, task: str, closed: bool) -> tuple:
        return run_id, task, *(("" if n == "resource" and x is None else x) for n, x in self.v.items()), closed


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["run_id", "task", *_NAMES, "closed"], dtype=object)
    return out.astype({"changes": "int64", "closed": "bool"})


class LifecycleProcessor(StatefulProcessor):
    def __init__(self, timeout_s: float | None = None):
        self.timeout_s = timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lifecycle", STATE)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        task = Lifecycle(tuple(self.state.get()) if self.state.exists() else None)
        before = task.v["changes"]
        rows = pd.concat(list(rows)).sort_values(["t", "rank"])
        rows = rows.astype(object).where(rows.notna(), None)
        for event in zip(*(rows[c] for c in ("kind", "t", "step", "resource_id", "elapsed_s", "bytes_staged", "wasted", "status")), strict=True):
            task.feed(*event)
        if not task.known:
            yield _frame([])
            return
        v = task.v
        self.state.update(tuple(int(x) if n in ("changes", "consumed_step") and x is not None else x for n, x in v.items()))
        if self.timeout_s is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((v["last_t"] + self.timeout_s) * 1000))
        yield _frame([task.row(*key, False)] if v["changes"] > before else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            out = [Lifecycle(tuple(self.state.get())).row(*key, True)]
            self.state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def lines(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The appended lines of all writers as a stream of events (see ``traces.load_events``; a stream has no line numbers)."""
    reader = spark.readStream.format("text")
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return parsed_lines(reader.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_no")))


def task_events(events: DataFrame) -> DataFrame:
    """run_id, task, rank, t, step, kind and the payload's fields of the events that can make a task."""
    p = F.from_json("payload", FIELDS)
    rows = events.where(F.col("event_type").isin(*KINDS)).withColumn("p", p)
    task = F.coalesce("p.task_id", F.lit(""))
    rows = rows.where((F.col("event_type") != "resource_consumed") | (task != ""))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type"))
    return rows.select("run_id", task.alias("task"), rank.alias("rank"), "t", "step", F.col("event_type").alias("kind"), "p.resource_id", "p.elapsed_s", "p.bytes_staged", "p.wasted", "p.status", F.timestamp_seconds("t").alias("at"))


def updates(events: DataFrame) -> DataFrame:
    """The lifecycles of a streaming (or batch) DataFrame of events, as rows of ``SCHEMA`` in which ``changes`` counts the task's events so far.

    The last event of each kind is kept; what the last start (or, without one, a task's first event but a consumption) came after is
    left out as the row is made. So the state is a few maxima, which combine before the shuffle and do not call Python."""
    rows, of = task_events(events), dict(zip(KINDS, "sexu", strict=True))
    last = lambda kind, *values: F.max(F.when(F.col("kind") == kind, F.struct("t", *values))).alias(of[kind])
    staged = F.when((F.col("kind") == "prefetch_completed") & F.col("bytes_staged").isNotNull(), F.struct("t", "bytes_staged"))
    first = F.min(F.when(F.col("kind") != "resource_consumed", F.struct("t", "rank")))
    held = rows.groupBy("run_id", "task").agg(last("prefetch_started", "resource_id"), last("prefetch_completed", "elapsed_s"), last("prefetch_cancelled", "wasted"), last("resource_consumed", "step", "status"), F.max(staged).alias("m"), first.alias("first"), F.count(F.lit(1)).alias("changes"))
    since = F.coalesce("s.t", "first.t")  # events at one t are taken in the order of kinds, a consumption last
    own = held.where("first is not null").withColumns({c: F.when(F.col(f"{c}.t") >= since, F.col(c)) for c in "exum"})
    elapsed = F.when(F.col("e").isNotNull(), F.coalesce("e.elapsed_s", F.lit(0.0)))
    timed = (F.coalesce("s.t", F.lit(0.0)) != 0) & (elapsed > 0)
    given = lambda c, value, default: F.when(F.col(c).isNotNull(), F.coalesce(value, F.lit(default)))
    out = {
        "started_t": F.col("s.t"), "resource": F.coalesce("s.resource_id", F.lit("")), "elapsed_s": elapsed, "completed_t": F.when(timed, F.col("s.t") + elapsed).otherwise(F.col("e.t")), "measured": F.col("m.bytes_staged"),
        "cancelled_t": F.col("x.t"), "wasted": given("x", "x.wasted", False), "consumed_t": F.col("u.t"), "consumed_step": F.col("u.step"), "status": given("u", "u.status", ""),
        "last_t": F.greatest("s.t", "e.t", "x.t", "u.t"), "changes": F.col("changes"), "closed": F.lit(False),
    }
    return own.select("run_id", "task", *[c.alias(n) for n, c in out.items()])


def append_updates(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing ``updates`` of what is new since ``checkpoint``: a folder under ``path`` for each micro-batch, which a
    repeated one replaces."""
    put = lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/batch={k}")
    return changed.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream(events: DataFrame, timeout_s: float | None = None, late_s: int = 0) -> DataFrame:
    """The lifecycles of a streaming DataFrame of events (RocksDB state store needed)."""
    rows = task_events(events)
    if timeout_s is not None:
        rows = rows.withWatermark("at", f"{late_s} seconds")
    return rows.groupBy("run_id", "task").transformWithStateInPandas(statefulProcessor=LifecycleProcessor(timeout_s), outputStructType=SCHEMA, outputMode="Append", timeMode="None" if timeout_s is None else "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each task of what the stream has emitted."""
    columns = [c for c in changes.columns if c not in ("run_id", "task")]
    return changes.groupBy("run_id", "task").agg(F.max_by(F.struct(*columns), F.struct("changes", "closed")).alias("r")).select("run_id", "task", "r.*")
