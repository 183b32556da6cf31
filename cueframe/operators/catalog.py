"""Format options, ordered unions, host tests, diffs, sizes."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueframe.functions.text import size_label

# Hosts of one video site.
VIDEO_HOSTS = ("youtube.com", "youtu.be")


def first_wins(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The union of the parts with the first row of each key: of the earliest part, then the least by ``order``."""
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("c_part", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    fields = [c for c in parts[0].columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct("c_part", *order, *fields)).alias("x"))
    return first.select(*keys, F.col("x.c_part").alias("part"), *[f"x.{c}" for c in [*order, *fields]])


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    fields = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *fields)).alias("x")).select(*keys, "x.*")


def is_host(url: Column, hosts: Sequence[str] = VIDEO_HOSTS) -> Column:
    """Whether the address's host is one of ``hosts`` or beneath one; false for no address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    out = F.lit(False)
    for name in hosts:
        out = out | (host == name) | host.endswith(f".{name}")
    return F.coalesce(out, F.lit(False))


def format_label(ident: Column, ext: Column, width: Column, height: Column, fps: Column, sound: Column, size: Column) -> Column:
    """Parts joined by " - "; null parts are left out."""
    frame = F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).when(height.isNotNull(), F.concat(height.cast("string"), F.lit("p")))
    rate = F.when(fps > 0, F.concat(F.regexp_replace(fps.cast("double").cast("string"), r"\.0$", ""), F.lit("fps")))
    return F.concat_ws(" - ", ident, F.nullif(F.upper(ext), F.lit("")), frame, rate, F.when(sound, "video + audio").otherwise("video + best audio"), size_label(size))


def complete_size(files: DataFrame) -> DataFrame:
    """``key, size``: the sum of a key's sizes, null if one is unknown."""
    return files.groupBy("key").agg(F.when(~F.bool_or(F.col("size").isNull()), F.sum("size")).alias("size"))


@F.pandas_udf(T.StringType())
def unified_diff(left: pd.Series, right: pd.Series) -> pd.Series:
    """The unified diff of two texts' lines; difflib has no counterpart among Spark's functions."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "a", "b", lineterm="")) for a, b in zip(left, right, strict=True)])
