"""Runs and tasks: listings, states, reuse and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
TERMINAL = ("aborted", "completed", "failed")


def active(runs: DataFrame, workflow_id: int | None = None) -> DataFrame:
    rows = runs.where(F.col("status").isin(*ACTIVE))
    return rows if workflow_id is None else rows.where(F.col("workflow_id") == workflow_id)


def ordered(runs: DataFrame) -> DataFrame:
    """By start, those not started first, then by id."""
    return runs.orderBy(F.col("started_at").asc_nulls_first(), "run_id")


def reusable(tasks: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted ``cache_key`` the newest task that is not aborted and whose run still exists."""
    rows = tasks.where(F.col("status") != "aborted").join(wanted.select("cache_key").distinct(), "cache_key", "left_semi").join(runs.select("run_id"), "run_id", "left_semi")
    return rows.groupBy("cache_key").agg(F.max(F.struct("updated_at", "run_id")).alias("x")).select("cache_key", "x.run_id", "x.updated_at")


def synced(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks with their run's state, and whether it differs from theirs; a task without a run stays as it is."""
    now = runs.select("run_id", F.col("status").alias("c_status"), F.lit(True).alias("c_known"))
    rows = tasks.join(now, "run_id", "left")
    changed = F.coalesce("c_known", F.lit(False)) & ~F.col("status").eqNullSafe(F.col("c_status"))
    return rows.select("run_id", "cache_key", F.when(changed, F.col("c_status")).otherwise(F.col("status")).alias("status"), changed.alias("changed"))


def effective(workflows: DataFrame, states: DataFrame) -> DataFrame:
    """The stored state of each workflow, or ``pending``."""
    return workflows.select("workflow_id").distinct().join(states, "workflow_id", "left").select("workflow_id", F.coalesce("status", F.lit("pending")).alias("status"))


def recovered(steps: DataFrame) -> DataFrame:
    """After a crash, steps that ran have failed."""
    return steps.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))
