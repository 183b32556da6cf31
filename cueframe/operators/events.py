"""The event log: sequences, tails, step states, progress and log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.timecode import clamped_percent


def appended(new: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """New events ``workflow_id, ts, event_id, ...`` with ``sequence`` after the log's last of their workflow."""
    out = new.withColumn("sequence", F.row_number().over(Window.partitionBy("workflow_id").orderBy("ts", "event_id")).cast("long"))
    if log is None:
        return out
    last = latest_sequence(log).withColumnRenamed("latest", "c_last")
    return out.join(last, "workflow_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("c_last", F.lit(0))).drop("c_last")


def after(log: DataFrame, sequence: int, workflow_id: int | None = None) -> DataFrame:
    rows = log.where(F.col("sequence") > sequence)
    return rows if workflow_id is None else rows.where(F.col("workflow_id") == workflow_id)


def latest_sequence(log: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """``workflow_id, latest``: 0 for a workflow (of ``workflows``) without events."""
    out = log.groupBy("workflow_id").agg(F.max("sequence").alias("latest"))
    if workflows is None:
        return out
    return workflows.select("workflow_id").distinct().join(out, "workflow_id", "left").select("workflow_id", F.coalesce("latest", F.lit(0)).alias("latest"))


def seen(log: DataFrame, completed: str, failed: str, started: str) -> DataFrame:
    """``workflow_id, done, failed, started``: the steps that were completed, and the one that failed, and started, last."""
    last = lambda kind: F.max_by("step", F.when(F.col("type") == kind, F.col("sequence")))
    return log.groupBy("workflow_id").agg(
        F.collect_set(F.when(F.col("type") == completed, F.col("step"))).alias("done"),
        F.when(F.count_if(F.col("type") == failed) > 0, last(failed)).alias("failed"),
        F.when(F.count_if(F.col("type") == started) > 0, last(started)).alias("started"),
    )


def statuses(found: DataFrame, runs: DataFrame, steps: int) -> DataFrame:
    """``workflow_id, step, status`` of steps 0 to ``steps`` - 1, from ``seen``.

    A completed run's steps are done; else the step that failed last has failed, completed ones are done, the one that started last runs while the run does, and a
    queued run's first step runs; the others are blocked.
    """
    rows = runs.select("workflow_id", "run_status").join(found, "workflow_id", "left").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(F.col("run_status") == "completed", "done").when(is_(F.col("failed") == F.col("step")), "failed").when(is_(F.array_contains("done", F.col("step"))), "done")
        .when((F.col("run_status") == "running") & is_(F.col("started") == F.col("step")), "running").when((F.col("run_status") == "queued") & (F.col("step") == 0), "running").otherwise("blocked")
    )
    return rows.select("workflow_id", F.col("step").cast("int").alias("step"), status.alias("status"))


def step_status(log: DataFrame, runs: DataFrame, steps: int, completed: str, failed: str, started: str) -> DataFrame:
    """``statuses`` of what a log has ``seen``."""
    return statuses(seen(log, completed, failed, started), runs, steps)


def status_counts(status: DataFrame) -> DataFrame:
    """``workflow_id, done, failed, running, percent``: halves go up."""
    count = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("workflow_id").agg(
        count("done").alias("done"), count("failed").alias("failed"), count("running").alias("running"), F.floor(100 * count("done") / F.count(F.lit(1)) + 0.5).cast("long").alias("percent")
    )


def progress_rows(log: DataFrame, kind: str) -> DataFrame:
    """Progress events with a step and a number, their percents from 0 to 100."""
    rows = log.where((F.col("type") == kind) & F.col("step").isNotNull() & F.col("percent").isNotNull() & ~F.isnan("percent"))
    return rows.withColumn("percent", clamped_percent(F.col("percent")))


def latest_progress(progress: DataFrame) -> DataFrame:
    """The row of the largest sequence of each (workflow, step), and of each attempt and phase where the reports have them."""
    keys = ["workflow_id", "step", *[c for c in ("attempt", "phase") if c in progress.columns]]
    return progress.groupBy(*keys).agg(F.max(F.struct("sequence", "percent")).alias("x")).select(*keys, "x.sequence", "x.percent")


def log_rows(log: DataFrame, kind: str) -> DataFrame:
    """``workflow_id, sequence, row, text``: each step's latest progress, and the messages of all events that are no progress."""
    progress = progress_rows(log, kind)
    latest = latest_progress(progress)
    text = F.concat(F.lit("step "), F.col("step").cast("string"), F.lit(" "), F.floor(F.col("percent") + 0.5).cast("string"), F.lit("%"))
    lines = latest.select("workflow_id", "sequence", F.lit("progress").alias("row"), text.alias("text"))
    rest = log.join(progress.select("workflow_id", "sequence"), ["workflow_id", "sequence"], "left_anti")
    return lines.unionByName(rest.select("workflow_id", "sequence", F.lit("text").alias("row"), F.col("type").alias("text")))


def emits(percent: float, phase: str, last: tuple[float, str] | None, delta: float = 1.0) -> bool:
    """Whether a progress report is passed on, given the last one that was; ``phase`` stands for phase and label."""
    if last is None or phase != last[1]:
        return True
    return (percent in (0.0, 100.0) and percent != last[0]) or abs(percent - last[0]) >= delta


def report_phase(progress: DataFrame) -> Column:
    """Phase and label of a report as one value."""
    return F.concat_ws("\x1f", *[F.col(c) if c in progress.columns else F.lit("") for c in ("phase", "label")]).alias("c_phase")


THROTTLED_COLUMNS = "workflow_id long, step int, sequence long, percent double"


def throttled(progress: DataFrame, delta: float = 1.0) -> DataFrame:
    """The reports of each (workflow, step, attempt) that are passed on: a report is compared with the last one passed, so this is a fold.

    The rows of a key are sorted by Spark within the partition and walked batch by batch; no group is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        last: tuple[float, str] | None = None
        for batch in batches:
            keep = []
            for w, s, a, p, phase in zip(batch["workflow_id"], batch["step"], batch["attempt"], batch["percent"], batch["c_phase"], strict=True):
                if (w, s, a) != key:
                    key, last = (w, s, a), None
                keep.append(emits(p, phase, last, delta))
                if keep[-1]:
                    last = (p, phase)
            yield batch.loc[keep, ["workflow_id", "step", "sequence", "percent"]]

    attempt = F.col("attempt").cast("int") if "attempt" in progress.columns else F.lit(1)
    rows = progress.select("workflow_id", F.col("step").cast("int").alias("step"), attempt.alias("attempt"), "sequence", "percent", report_phase(progress))
    keys = ["workflow_id", "step", "attempt"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sequence").mapInPandas(run, THROTTLED_COLUMNS)


def byte_totals(reports: DataFrame) -> DataFrame:
    """``key, at, total``: bytes over all bars of a key, counting what each bar has grown; ``reports``: ``key, bar, at, bytes``."""
    bar = Window.partitionBy("key", "bar").orderBy("at")
    grown = F.greatest(F.col("bytes") - F.coalesce(F.lag("bytes").over(bar), F.lit(0)), F.lit(0))
    rows = reports.withColumn("c_grown", grown)
    return rows.select("key", "bar", "at", F.sum("c_grown").over(Window.partitionBy("key").orderBy("at", "bar").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def sse(log: DataFrame) -> DataFrame:
    """Server-sent event text of each event."""
    body = F.to_json(F.struct("sequence", "step", "type", "workflow_id"))
    return log.select("workflow_id", "sequence", F.concat(F.lit("id: "), F.col("sequence").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("text"))
