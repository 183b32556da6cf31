"""Streaming forms: numbering, throttling and step counts of a live event log.

Events carry ``workflow_id, step, percent, event_id``; the order is that of arrival, as the log has no event time to be late by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueframe.operators.events import emits, report_phase


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, sorted as a whole: Spark hands them over in several frames."""
    return pd.concat(list(frames), ignore_index=True).sort_values("event_id")


def numbered(stream: DataFrame) -> DataFrame:
    """``workflow_id, event_id, sequence``: counted on per workflow across micro-batches."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = _in_order(frames)
        yield pd.DataFrame({"workflow_id": key[0], "event_id": rows["event_id"], "sequence": range(at + 1, at + 1 + len(rows))})
        state.update((at + len(rows),))

    rows = stream.select("workflow_id", "event_id")
    return rows.groupBy("workflow_id").applyInPandasWithState(count, "workflow_id long, event_id long, sequence long", "at long", "append", GroupStateTimeout.NoTimeout)


def throttled(stream: DataFrame, delta: float = 1.0) -> DataFrame:
    """The progress reports of each (workflow, step, attempt) that are passed on, compared with the last one passed in any micro-batch."""

    def pick(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, keep = tuple(state.get) if state.exists else None, []
        rows = _in_order(frames)
        for p, phase in zip(rows["percent"], rows["c_phase"], strict=True):
            keep.append(emits(p, phase, last, delta))
            if keep[-1]:
                last = (p, phase)
        yield pd.DataFrame({"workflow_id": key[0], "step": key[1], "event_id": rows["event_id"][keep], "percent": rows["percent"][keep]})
        if last is not None:
            state.update(last)

    attempt = F.col("attempt").cast("int") if "attempt" in stream.columns else F.lit(1)
    rows = stream.select("workflow_id", F.col("step").cast("int").alias("step"), attempt.alias("attempt"), "event_id", "percent", report_phase(stream))
    keyed = rows.groupBy("workflow_id", "step", "attempt")
    return keyed.applyInPandasWithState(pick, "workflow_id long, step int, event_id long, percent double", "last double, phase string", "append", GroupStateTimeout.NoTimeout)


def counts(stream: DataFrame) -> DataFrame:
    """Events of each workflow and type so far, for ``complete`` or ``update`` mode."""
    return stream.groupBy("workflow_id", "type").agg(F.count(F.lit(1)).alias("n"))
