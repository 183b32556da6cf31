"""Artifacts and their versions: numbering, current versions, filters, bindings, reuse, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.hashing import content_hash


def appended(versions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New ``artifact_id, created_at, content, ...`` with ``version`` after the known ones' last and the content's hash and size."""
    at = F.row_number().over(Window.partitionBy("artifact_id").orderBy("created_at", "content")).cast("long")
    new = versions.withColumn("version", at)
    if known is not None:
        last = known.groupBy("artifact_id").agg(F.max("version").alias("c_last"))
        new = new.join(last, "artifact_id", "left").withColumn("version", F.col("version") + F.coalesce("c_last", F.lit(0))).drop("c_last")
    text = F.col("content").cast("string")
    return new.withColumn("content_hash", content_hash(text)).withColumn("content_size", F.octet_length(text).cast("long"))


def current(versions: DataFrame) -> DataFrame:
    """The last version of each artifact; a partial aggregate on each task, then one small row per artifact is shuffled."""
    fields = [c for c in versions.columns if c not in ("artifact_id", "version")]
    last = versions.groupBy("artifact_id").agg(F.max(F.struct("version", *fields)).alias("x"))
    return last.select("artifact_id", "x.*")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: upserts as appended rows."""
    fields = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *fields)).alias("x")).select(*keys, "x.*")


def listed(now: DataFrame, workflow_id: int | None = None, step: str | None = None, kind: str | None = None) -> DataFrame:
    """Current versions of one workflow, step (by id or the name's prefix) and type."""
    if workflow_id is not None:
        now = now.where(F.col("workflow_id") == workflow_id)
    if step is not None:
        by = F.col("created_by_step_id") == step if "created_by_step_id" in now.columns else F.lit(False)
        now = now.where(by | F.col("name").startswith(f"{step}."))
    return now if kind is None else now.where(F.col("type") == kind)


def latest_by_name(now: DataFrame) -> DataFrame:
    """Of the artifacts of one type, name and workflow, the one changed last; ties go to the larger id."""
    return now.groupBy("type", "name", "workflow_id").agg(F.max(F.struct("created_at", "artifact_id", "version", "content")).alias("x")).select("type", "name", "workflow_id", "x.*")


def bindings(versions: DataFrame) -> DataFrame:
    """``workflow_id, name, artifact_id, version``: what each step output is bound to; a later version overwrites."""
    rows = versions.groupBy("workflow_id", "name").agg(F.max(F.struct("created_at", "artifact_id", "version")).alias("x"))
    return rows.select("workflow_id", "name", "x.artifact_id", "x.version")


def preview(content: Column, most: int) -> tuple[Column, Column]:
    """The first ``most`` bytes as text, a cut character left out, and whether something was cut."""
    raw = F.encode(content, "UTF-8")
    cut = F.length(raw) > most
    return F.when(cut, _whole_characters(raw, most)).otherwise(content), cut


def _whole_characters(raw: Column, most: int) -> Column:
    """``raw`` cut at ``most`` bytes or, where that splits a character, at the character's first byte."""
    byte = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int")
    past = F.lit(most)
    for back in (3, 2, 1, 0):
        # The byte after the cut is a continuation byte (128 to 191) as long as the cut splits a character.
        past = F.when((byte(most + 1 - back) < 128) | (byte(most + 1 - back) > 191), F.lit(most - back)).otherwise(past)
    return F.decode(F.substring(raw, F.lit(1), past), "UTF-8")


def run_bindings(step_runs: DataFrame) -> DataFrame:
    """``workflow_id, selector, artifact_id, version`` from ``workflow_id, position, status, step_id, outputs`` (name, artifact_id, version).

    Completed step runs count, in the order of their positions whatever the times of their artifacts; a later run overwrites, within one the last entry of a name.
    """
    rows = step_runs.where((F.col("status") == "completed") & F.col("step_id").isNotNull())
    rows = rows.select("workflow_id", "position", "step_id", F.posexplode("outputs").alias("c_at", "c_out"))
    last = rows.groupBy("workflow_id", F.concat("step_id", F.lit("."), "c_out.name").alias("selector")).agg(F.max(F.struct("position", "c_at", "c_out.artifact_id", "c_out.version")).alias("c_x"))
    return last.select("workflow_id", "selector", "c_x.artifact_id", "c_x.version")
