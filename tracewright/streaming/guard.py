"""The prediction guard as one keyed state machine, over batches and streams alike.

Events: run_id, ord, step, kind (prediction or tool), tool (predicted or actual), expected_at. ``queue`` mode:
a tool meets the oldest earlier prediction that it equals or starts with; equality is a hit, a prefix alone a
divergence, no match is silent; predictions expire by age. ``slot`` mode: one pending prediction, judged at
the first tool from its expected step on, by equality. A divergence suppresses predictions for some
steps. A run's state is small and its events are taken in order of ``ord``; events without a run_id have no verdict.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run_id long, ord long, step int, tool string, outcome string, expected string, conservative boolean"
HORIZON, CONSERVATIVE_STEPS = 3, 3


class Guard:
    """State of one run; ``feed`` takes an event and gives the tool's verdict or nothing."""

    def __init__(self, mode: str = "queue", horizon: int = HORIZON, steps: int = CONSERVATIVE_STEPS, state: str | None = None):
        self.mode, self.age, self.steps = mode, max(8 * horizon, 60), steps
        self.pending, self.until = json.loads(state) if state else ([], 0)

    def dump(self) -> str:
        return json.dumps([self.pending, self.until])

    def feed(self, step: int, kind: str, tool: str, expected_at: int) -> tuple[str, str | None, bool] | None:
        if kind == "prediction":
            if step > self.until:
                entry = [step, tool, expected_at]
                self.pending = [entry] if self.mode == "slot" else [*self.pending, entry]
            return None
        outcome, expected = (self._slot if self.mode == "slot" else self._queue)(step, tool)
        if outcome == "diverged":
            self.until = step + self.steps
        return outcome, expected, step <= self.until

    def _queue(self, step: int, tool: str) -> tuple[str, str | None]:
        self.pending = [p for p in self.pending if step - p[0] <= self.age]
        for k, (made, expected, _) in enumerate(self.pending):
            if made < step and tool.startswith(expected):
                del self.pending[k]
                return ("hit" if tool == expected else "diverged"), expected
        return "silent", None

    def _slot(self, step: int, tool: str) -> tuple[str, str | None]:
        if not self.pending or step < self.pending[0][2]:
            return "silent", None
        expected = self.pending.pop()[1]
        return ("hit" if tool == expected else "diverged"), expected


COLUMNS = ["run_id", "ord", "step", "tool", "outcome", "expected", "conservative"]


def _verdicts(guard: Guard, run_id, rows: pd.DataFrame) -> list[tuple]:
    """Of rows in order of ``ord``."""
    out = []
    for ord_, step, kind, tool, expected_at in zip(rows["ord"], rows["step"], rows["kind"], rows["tool"], rows["expected_at"], strict=True):
        got = guard.feed(int(step), kind, tool or "", int(expected_at))
        if got:
            out.append((run_id, ord_, step, tool, *got))
    return out


def replay(events: DataFrame, mode: str = "queue") -> DataFrame:
    """A verdict for each tool event of a batch. Runs are sorted by Spark, which may spill, and read in batches: a task holds
    one batch and the state of one run, however long the run is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard, own, started = Guard(mode), None, False
        for rows in batches:
            out: list[tuple] = []
            edges = rows["run_id"].ne(rows["run_id"].shift()).to_numpy().nonzero()[0].tolist()
            for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
                part = rows.iloc[a:b]
                run_id = part["run_id"].iloc[0]
                if not started or run_id != own:
                    guard, own, started = Guard(mode), run_id, True
                out += _verdicts(guard, run_id, part)
            yield pd.DataFrame(out, columns=COLUMNS)

    rows = events.where("run_id is not null").select("run_id", "ord", "step", "kind", "tool", "expected_at")
    return rows.repartition("run_id").sortWithinPartitions("run_id", "ord").mapInPandas(run, SCHEMA)


class GuardProcessor(StatefulProcessor):
    """The same machine on a stream; within a micro-batch a run's events are sorted."""

    def __init__(self, mode: str = "queue"):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("guard", "state string")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        guard = Guard(self.mode, state=self.state.get()[0] if self.state.exists() else None)
        out = _verdicts(guard, key[0], pd.concat(list(rows)).sort_values("ord"))
        self.state.update((guard.dump(),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream(events: DataFrame, mode: str = "queue") -> DataFrame:
    """Verdicts of a streaming DataFrame (RocksDB state store needed)."""
    return events.groupBy("run_id").transformWithStateInPandas(statefulProcessor=GuardProcessor(mode), outputStructType=SCHEMA, outputMode="Append", timeMode="None")
