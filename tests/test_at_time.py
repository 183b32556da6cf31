"""The segment at a time against the definition, in one sorted walk."""

from __future__ import annotations

import random

import pytest

from cueframe.operators import review

SEGMENTS, TIMES = "key long, idx long, start_ms long, end_ms long", "key long, t long"


@pytest.mark.parametrize("rows", [3, 10_000])
def test_the_segment_at_a_time(spark, rows):
    rng = random.Random(6)
    segments, times = [], []
    for key in range(40):
        starts = rng.sample(range(100), rng.randint(0, 8))
        segments += [(key, k, s, s + rng.choice([0, 3, 10, 60])) for k, s in enumerate(starts)]
        times += [(key, rng.randint(-5, 170)) for _ in range(25)]
    wanted = {}
    for key, t in times:
        own = sorted((s, k, e) for w, k, s, e in segments if w == key)
        holds, by = [k for s, k, e in own if s <= t <= e], [k for s, k, e in own if s <= t]
        wanted[key, t] = holds[0] if holds else by[-1] if by else own[0][1] if own else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = review.at_time(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(times, TIMES))
        found = [((r.key, r.t), r.idx) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(wanted) and dict(found) == wanted


def test_one_sort_and_no_window(spark):
    """Four windows over three sorts held rows of a task several times."""
    got = review.at_time(spark.createDataFrame([(1, 0, 0, 5)], SEGMENTS), spark.createDataFrame([(1, 3)], TIMES))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan
