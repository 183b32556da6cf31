"""The task monitor as one stateful stream: what each workflow's steps have done, their latest progress, and the reports that are passed on.

Events of a workflow are taken in order of ``sequence``: one that comes early waits in the state until those before it are there, however micro-batches and their parts are cut.
The state holds the waiting events, and in one value the next sequence, the steps, and for each step the last progress; it goes ``keep_ms`` after the workflow's last event.  A timer tells of a workflow
whose last started step has had no event for ``stall_ms``.

Rows of the output, told apart by ``kind``:

- ``seen``: ``done`` (steps), ``failed`` and ``started`` (the last such step) after ``sequence``; the row of the largest sequence of a workflow counts, as in ``events.seen``;
- ``progress``: the latest report of a step, in each batch that has one;
- ``report``: a report that is passed on, once each, as in ``events.throttled``;
- ``stalled``: the step, with the last sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cueframe.operators.events import emits

OUTPUT = "workflow_id long, kind string, sequence long, step int, percent double, done array<int>, failed int, started int"
_OUT = [c.split()[0] for c in OUTPUT.split(", ")]
_EVENT = "type string, step int, percent double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Monitor(StatefulProcessor):
    """``kinds``: the event types that mean completed, failed, started, and progress."""

    def __init__(self, completed: str, failed: str, started: str, progress: str, delta: float, stall_ms: int | None, keep_ms: int | None) -> None:
        self.completed, self.failed, self.started, self.progress = completed, failed, started, progress
        self.delta, self.stall_ms, self.keep_ms = delta, stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value for all that a batch always needs: each call of a state is a round trip to the store.  The steps of a workflow are few, and go out with each batch anyway.
        self.head = handle.getValueState("head", "next long, failed int, started int, done array<int>, steps array<int>, percents array<double>", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "sequence long", _EVENT, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (workflow,) = key
        at, failed, started, known, steps, percents = self.head.get() or (1, None, None, (), (), ())
        first, done, held = at, set(known), self.waiting.exists()
        passed: dict[int, float] = dict(zip(steps, percents, strict=True))
        latest: dict[int, tuple[int, float]] = {}
        reports: list[tuple] = []

        def take(event: tuple) -> None:
            nonlocal failed, started
            kind, step, percent = event
            if kind == self.completed and step is not None:
                done.add(step)
            elif kind == self.failed:
                failed = step
            elif kind == self.started:
                started = step
            elif kind == self.progress and step is not None and percent is not None:
                percent = min(100.0, max(0.0, percent))
                latest[step] = at, percent
                if emits(percent, "", (passed[step], "") if step in passed else None, self.delta):
                    passed[step] = percent
                    reports.append((at, step, percent))

        for frame in rows:
            events = zip(frame["sequence"].tolist(), frame["type"].tolist(), frame["step"].tolist(), frame["percent"].tolist(), strict=True)
            for sequence, *event in sorted(events, key=lambda e: e[0]):
                event = event[0], None if pd.isna(event[1]) else int(event[1]), None if pd.isna(event[2]) else float(event[2])
                if sequence > at:
                    self.waiting.updateValue((sequence,), event)
                    held = True
                elif sequence == at:
                    take(event)
                    at += 1
            while held and self.waiting.containsKey((at,)):
                take(tuple(self.waiting.getValue((at,))))
                self.waiting.removeKey((at,))
                at += 1
        self.head.update((at, failed, started, sorted(done), list(passed), list(passed.values())))
        if self.stall_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if started is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        if at > first:
            out = [(workflow, "report", sequence, step, percent, None, None, None) for sequence, step, percent in reports]
            out += [(workflow, "progress", sequence, step, percent, None, None, None) for step, (sequence, percent) in latest.items()]
            out.append((workflow, "seen", at - 1, None, None, sorted(done), failed, started))
            yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            at, _, started, *_ = self.head.get()
            yield _frame([(key[0], "stalled", at - 1, started, None, None, None, None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_OUT)
    for name in ("step", "failed", "started"):
        out[name] = out[name].astype("Int32")
    return out


def monitored(stream: DataFrame, completed: str, failed: str, started: str, progress: str, delta: float = 1.0, stall_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """``OUTPUT`` of a stream ``workflow_id, sequence, type, step, percent``; the session's state store must be RocksDB (``STATE_STORE``)."""
    rows = stream.select("workflow_id", "sequence", "type", F.col("step").cast("int").alias("step"), F.expr("IF(isnan(percent), NULL, percent)").alias("percent"))
    processor = Monitor(completed, failed, started, progress, delta, stall_ms, keep_ms)
    return rows.groupBy("workflow_id").transformWithStateInPandas(processor, OUTPUT, "Append", "None" if stall_ms is None and keep_ms is None else "ProcessingTime")


def final(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stands at last in the rows of ``monitored``: ``seen`` of each workflow, latest progress of each step, and all reports."""
    last = found.where("kind = 'seen'").groupBy("workflow_id").agg(F.max_by(F.struct("done", "failed", "started"), "sequence").alias("x")).select("workflow_id", "x.*")
    progress = found.where("kind = 'progress'").groupBy("workflow_id", "step").agg(F.max(F.struct("sequence", "percent")).alias("x")).select("workflow_id", "step", "x.*")
    return last, progress, found.where("kind = 'report'").select("workflow_id", "step", "sequence", "percent")
