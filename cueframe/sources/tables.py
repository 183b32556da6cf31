"""The driver's tables, and the timed-text views that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_segments(conversations: DataFrame) -> DataFrame:
    """One segment per turn: ``conv_id, turn, first_word, words, start_ms, end_ms, text``.  Word i of a conversation lasts from ``350 i + 700 turn`` for 300 ms.

    The words are counted per turn before they are numbered, so the window sorts turns, not words.
    """
    rows = conversations.select("conv_id", "turn", "text", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("first_word", F.sum("n").over(order) - F.col("n"))
    start = 350 * F.col("first_word") + 700 * F.col("turn")
    return rows.select("conv_id", "turn", "first_word", "words", start.alias("start_ms"), (start + 350 * (F.col("n") - 1) + 300).alias("end_ms"), "text")


def timed_words(segments: DataFrame) -> DataFrame:
    """``conv_id, turn, i, start_ms, end_ms, word`` of each segment's words."""
    rows = segments.select("conv_id", "turn", "first_word", F.posexplode("words").alias("pos", "word"))
    i = F.col("first_word") + F.col("pos")
    start = 350 * i + 700 * F.col("turn")
    return rows.select("conv_id", "turn", i.alias("i"), start.alias("start_ms"), (start + 300).alias("end_ms"), "word")


def workflow_events(events: DataFrame) -> DataFrame:
    """The event log as workflow events: ``workflow_id, sequence, type, step, percent, ts, event_id``."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(6)).cast("int")
    return events.select(F.col("user_id").alias("workflow_id"), F.row_number().over(order).cast("long").alias("sequence"), F.col("event_type").alias("type"), step.alias("step"), F.col("value").alias("percent"), "ts", "event_id")


VERSION_KEYS = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def artifact_versions(lineitem: DataFrame) -> DataFrame:
    """Line items as versions of the artifact of their order, numbered by date and then all other columns."""
    order = Window.partitionBy("l_orderkey").orderBy(*VERSION_KEYS)
    return lineitem.select(
        F.col("l_orderkey").alias("artifact_id"),
        F.row_number().over(order).cast("long").alias("version"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_linestatus").alias("type"),
        F.concat(F.lit("step"), F.pmod("l_linenumber", F.lit(4)).cast("string"), F.lit("."), F.col("l_returnflag")).alias("name"),
        (F.pmod("l_suppkey", F.lit(50))).alias("workflow_id"),
        F.col("l_partkey").alias("content"),
    )
