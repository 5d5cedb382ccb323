"""Admission, completion, cancellation and consumption of fetches as one keyed state machine, over batches and streams.

Events: run_id, ord, kind, resource, checkpoint, action, reason. ``predicted`` asks for a fetch of the resource: while one is running or complete
it is skipped; otherwise the policy's verdict (action, reason: see ``scalars.admission``, worked out in columns beforehand) decides. ``completed``
ends the resource's running fetch. ``diverged`` cancels what the checkpoint's predictions started and nobody used; a complete one is wasted.
``consumed`` uses the resource's fetch unless there is none or it is gone. A consumption before the completion uses the fetch as
well, and a completion after it changes nothing.

What is emitted: decisions, starts, cancellations (in the order of the starts) and consumptions, with the task concerned. A task is named
by the event that started it. A resource has one live fetch at most, so a run's state has an entry a resource, whatever the run's
length. Events without a run_id or of another kind emit nothing; a null resource or checkpoint is a name like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run_id long, ord long, place int, event string, resource string, task string, action string, reason string, status string, wasted boolean"
COLUMNS = ["run_id", "ord", "place", "event", "resource", "task", "action", "reason", "status", "wasted"]
INPUT = ["run_id", "ord", "kind", "resource", "checkpoint", "action", "reason"]


class Scheduler:
    """The fetches of one run: resource to [task, checkpoint, status, start], the oldest start first."""

    def __init__(self, fetches: dict[str, list] | None = None):
        self.fetches = fetches or {}

    def feed(self, ord_: int, kind: str, resource: str, checkpoint: str, action: str | None, reason: str | None) -> list[tuple]:
        """(event, resource, task, action, reason, status, wasted) of what the event leads to."""
        own = self.fetches.get(resource)
        if kind == "predicted":
            if own and own[2] in ("in_progress", "completed"):
                return [("prefetch_decision", resource, None, "skip", "already_in_flight_or_complete", None, None)]
            if not action:  # an observing run decides nothing
                return []
            out = [("prefetch_decision", resource, None, action, reason, None, None)]
            if action == "start":
                self.fetches.pop(resource, None)
                self.fetches[resource] = [f"T{ord_}", checkpoint, "in_progress", ord_]
                out.append(("prefetch_started", resource, f"T{ord_}", None, None, "in_progress", None))
            return out
        if kind == "completed" and own and own[2] == "in_progress":
            own[2] = "completed"
            return [("prefetch_completed", resource, own[0], None, None, "completed", None)]
        if kind == "consumed":
            if own is None or own[2] in ("cancelled", "wasted"):
                return [("resource_consumed", resource, None, None, None, "no_prefetch", None)]
            own[2] = "used"
            return [("resource_consumed", resource, own[0], None, None, "used", None)]
        if kind == "diverged":
            out = []
            for name, fetch in self.fetches.items():
                if fetch[1] == checkpoint and fetch[2] in ("in_progress", "completed"):
                    before, fetch[2] = fetch[2], "wasted" if fetch[2] == "completed" else "cancelled"
                    out.append(("prefetch_cancelled", name, fetch[0], None, None, before, before == "completed"))
            return out
        return []


def _emitted(scheduler: Scheduler, run_id, rows: pd.DataFrame) -> list[tuple]:
    """Of rows in order of ``ord``."""
    out = []
    for ord_, *event in zip(*(rows[c] for c in INPUT[1:]), strict=True):
        out += [(run_id, ord_, place, *e) for place, e in enumerate(scheduler.feed(ord_, *event))]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"wasted": "object"})


def replay(events: DataFrame) -> DataFrame:
    """All that the events of a batch lead to. Spark sorts the runs, which may spill; a task holds a batch and one run's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheduler, own, started = Scheduler(), None, False
        for rows in batches:
            out: list[tuple] = []
            edges = rows["run_id"].ne(rows["run_id"].shift()).to_numpy().nonzero()[0].tolist()
            for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
                part = rows.iloc[a:b]
                run_id = part["run_id"].iloc[0]
                if not started or run_id != own:
                    scheduler, own, started = Scheduler(), run_id, True
                out += _emitted(scheduler, run_id, part)
            yield _frame(out)

    rows = events.where("run_id is not null").select(*INPUT)
    return rows.repartition("run_id").sortWithinPartitions("run_id", "ord").mapInPandas(run, SCHEMA)


class SchedulerProcessor(StatefulProcessor):
    """The same machine on a stream, with typed state: an entry a resource of the run. Micro-batches come in order; within one a run's
    events are sorted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetches = handle.getMapState("fetches", "resource string", "task string, checkpoint string, status string, start bigint")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: list(v) for k, v in self.fetches.iterator()}
        scheduler = Scheduler(dict(sorted(held.items(), key=lambda x: x[1][3])))
        before = {k: tuple(v) for k, v in scheduler.fetches.items()}
        out = _emitted(scheduler, key[0], pd.concat(list(rows)).sort_values("ord"))
        for k, v in scheduler.fetches.items():
            if before.get(k) != tuple(v):
                self.fetches.updateValue((k,), (v[0], v[1], v[2], int(v[3])))
        yield _frame(out)

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """The same over a streaming DataFrame (RocksDB state store needed)."""
    return events.where("run_id is not null").select(*INPUT).groupBy("run_id").transformWithStateInPandas(statefulProcessor=SchedulerProcessor(), outputStructType=SCHEMA, outputMode="Append", timeMode="None")
