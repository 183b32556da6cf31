"""Workflow graphs as rows: checks of all workflows' references at once, and the steps that a change makes stale.

Steps are ``workflow_id, place, step_id, outputs`` (an array of names), inputs ``workflow_id, place, name, value`` of the step at that place.  A value of the form
``step.output`` refers to a step of the same workflow, but ``project.name`` and other values are plain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.operators.content import SELECTOR
from cueframe.sources.store import shared_folder

# Fixed value: the selector's first part that names no step.
PROJECT = "project"


def references(inputs: DataFrame) -> DataFrame:
    """``workflow_id, place, name, step, output`` of the inputs that refer to a step."""
    part = lambda k: F.regexp_extract("value", SELECTOR, k)
    return inputs.where(F.col("value").rlike(SELECTOR)).select("workflow_id", "place", "name", part(1).alias("step"), part(2).alias("output")).where(F.col("step") != PROJECT)


def resolved(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """References with the place of their own step's id and of the step meant (``at``, null if there is none), and whether that one has the output.

    Of steps that share an id the last is meant.
    """
    own = steps.select("workflow_id", "place", "step_id")
    last = steps.groupBy("workflow_id", F.col("step_id").alias("step")).agg(F.max(F.struct("place", "outputs")).alias("c_to"))
    rows = references(inputs).join(own, ["workflow_id", "place"]).join(last, ["workflow_id", "step"], "left")
    has = F.coalesce(F.array_contains("c_to.outputs", F.col("output")), F.lit(False))
    return rows.select("workflow_id", "place", "step_id", "name", "step", F.col("c_to.place").alias("at"), has.alias("has_output"))


def problems(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """``workflow_id, place, name, problem``: steps whose id an earlier one has (without a name), and each bad reference with what is first wrong with it."""
    first = steps.groupBy("workflow_id", "step_id").agg(F.min("place").alias("c_first"))
    again = steps.join(first, ["workflow_id", "step_id"]).where("place > c_first").select("workflow_id", "place", F.lit(None).cast("string").alias("name"), F.lit("repeated step").alias("problem"))
    wrong = F.when(F.col("step") == F.col("step_id"), "self-reference").when(F.col("at").isNull(), "unknown step").when(F.col("at") > F.col("place"), "forward reference").when(~F.col("has_output"), "unknown output")
    bad = resolved(steps, inputs).select("workflow_id", "place", "name", wrong.alias("problem")).where("problem IS NOT NULL")
    return again.unionByName(bad)


def edges(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """``workflow_id, source, place``: the step at ``place`` takes something of the one at ``source``; good references only."""
    good = (F.col("at") < F.col("place")) & F.col("has_output") & (F.col("step") != F.col("step_id"))
    return resolved(steps, inputs).where(good).select("workflow_id", F.col("at").alias("source"), "place").distinct()


def stale(graph: DataFrame, changed: DataFrame) -> DataFrame:
    """``workflow_id, place, distance``: the changed steps (0) and all that take from them, over however many steps between.

    Each round asks only for what takes from the steps that the round before found, and writes it, so a lost executor costs one round.  An edge goes once its source or its place is
    found, as it can find nothing new then; a round reads the edges that are left, and no earlier round's steps.
    """
    spark = graph.sparkSession
    path = shared_folder(spark, "stale")
    edge, step = ["workflow_id", "source", "place"], ["workflow_id", "place"]
    schema, kept = changed.select(*step, F.lit(0).alias("distance")).schema, graph.select(*edge, F.lit(True).alias("c_head")).schema
    new, left, distance = changed.select(*step).distinct(), graph.select(*edge), 0
    while True:
        new.withColumn("distance", F.lit(distance)).write.parquet(f"{path}/found/{distance:06}")
        now = spark.read.schema(schema).parquet(f"{path}/found/{distance:06}").select(*step)
        if now.isEmpty():
            return spark.read.schema(schema).parquet(*[f"{path}/found/{k:06}" for k in range(distance + 1)])
        # Edges to what is not found yet, and whether their source was found in the last round; none has an older one.
        heads = now.select("workflow_id", F.col("place").alias("source"), F.lit(True).alias("c_head"))
        rows = left.join(now, step, "left_anti").join(heads, ["workflow_id", "source"], "left").select(*edge, F.col("c_head").isNotNull().alias("c_head"))
        rows.write.parquet(f"{path}/left/{distance:06}")
        rows = spark.read.schema(kept).parquet(f"{path}/left/{distance:06}")
        new, left = rows.where("c_head").select(*step).distinct(), rows.where("NOT c_head").select(*edge)
        distance += 1
