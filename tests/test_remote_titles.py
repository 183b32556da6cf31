"""Titles of remote videos against the definition, and without a row for each pair."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from cueframe.operators import models

TASKS, VIDEOS = "run_id long, workflow_id long, source_uri string", "workflow_id long, place long, url string, title string"


def test_titles_equal_the_definition(spark):
    rng = random.Random(4)
    url = lambda: rng.choice([None, "", "a", "b", "c"])
    tasks = [(k, rng.choice([None, 0, 1, 2, 3]), url()) for k in range(80)]
    for seed in range(3):
        rng = random.Random(seed)
        videos = [(rng.choice([0, 1, 2]), k if rng.random() < 0.9 else None, url(), rng.choice([None, " ", f" t{k} "])) for k in range(rng.choice([6, 40]))]
        wanted = {}
        for run, workflow, source in tasks:
            hits = [(p, t.strip()) for w, p, u, t in videos if w == workflow and (t or "").strip() and (u is None or source == "" or (source is not None and u == source))]
            if hits:
                wanted[run] = min((h for h in hits if h[0] is not None), default=(0, None))[1]
        got = models.remote_title(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(videos, VIDEOS))
        assert {r.run_id: r.title for r in got.collect()} == wanted


def test_one_workflow_makes_no_pairs(spark):
    """60,000 tasks and 60,000 videos of one workflow would be 3.6 billion pairs."""
    rows = spark.range(60_000)
    tasks = rows.select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("workflow_id"), F.lit("").alias("source_uri"))
    videos = rows.select(F.lit(1).cast("long").alias("workflow_id"), F.col("id").alias("place"), F.concat(F.lit("u"), F.col("id") % 7).alias("url"), F.concat(F.lit("t"), "id").alias("title"))
    start = time.time()
    assert models.remote_title(tasks, videos).groupBy("title").count().collect() == [("t0", 60_000)]
    assert time.time() - start < 60
