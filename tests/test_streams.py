"""The tail goes on from its offsets, its sink writes a batch once, and the stateful monitor equals the batch queries however events arrive."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from cueframe.operators import events
from cueframe.sources.files import read_files
from cueframe.streaming import event_log, monitor

LOG = "workflow_id long, sequence long, type string, step int, percent double, event_id long"
KINDS = {"completed": "done", "failed": "error", "started": "start", "progress": "work"}


def log_of(seed, sizes):
    rng, out = random.Random(seed), []
    for workflow, n in sizes.items():
        for k in range(1, n + 1):
            kind = rng.choice(["done", "error", "start", "work", "work", "note"])
            percent = rng.choice([None, float("nan"), -5.0, 140.0, rng.uniform(0, 100)]) if kind == "work" else None
            out.append((workflow, k, kind, rng.choice([0, 1, 2, None]), percent, workflow * 10_000 + k))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def sse_of(spark, path):
    out = {}
    for r in read_files(spark, path).orderBy("name").collect():
        out.setdefault(r.name.split("/")[1], []).append(bytes(r.content).decode())
    return {k: "".join(v) for k, v in out.items()}


def wanted_sse(spark, rows):
    out = {}
    for r in events.sse(frame(spark, rows)).orderBy("workflow_id", "sequence").collect():
        out[f"{r.workflow_id}.sse"] = out.get(f"{r.workflow_id}.sse", "") + r.text
    return out


def test_tail_goes_on_after_its_offsets(spark, tmp_path):
    rows, log, out, check = log_of(1, {1: 23, 2: 7, 30: 3}), str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")
    parts = [[r for r in rows if r[1] <= 5], [r for r in rows if 5 < r[1] <= 6 and r[0] != 2], [r for r in rows if r[1] > 6 or (r[0] == 2 and r[1] > 5)]]
    for k, part in enumerate(parts):
        event_log.append_log(frame(spark, part).repartition(3), log, 4)
        event_log.write_sse(event_log.tail(spark, log), out, check).awaitTermination()
        assert sse_of(spark, out) == wanted_sse(spark, [r for p in parts[: k + 1] for r in p])
    event_log.write_sse(event_log.tail(spark, log), out, check).awaitTermination()
    assert sse_of(spark, out) == wanted_sse(spark, rows)
    # A batch that was written but not committed is run again, and its events stand once.
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    event_log.write_sse(event_log.tail(spark, log), out, check).awaitTermination()
    assert sse_of(spark, out) == wanted_sse(spark, rows)


def test_tail_waits_at_a_gap_and_takes_one_workflow(spark, tmp_path):
    rows, log = log_of(2, {1: 9, 2: 9}), str(tmp_path / "log")
    event_log.append_log(frame(spark, [r for r in rows if not 3 < r[1] <= 6]), log, 3)
    reader = event_log.TailReader(log, None, 0)
    assert reader.latestOffset() == {"1": 3, "2": 3}
    event_log.append_log(frame(spark, [r for r in rows if r[0] == 1 and 3 < r[1] <= 6]), log, 3)
    assert reader.latestOffset() == {"1": 9, "2": 3}
    assert event_log.TailReader(log, 2, 0).latestOffset() == {"2": 3} and event_log.TailReader(log, 2, 6).latestOffset() == {"2": 9}
    got = sorted(e[1] for p in reader.partitions({"1": 4}, {"1": 8, "2": 0}) for e in reader.read(p))
    assert got == [5, 6, 7, 8]
    assert event_log.TailReader(str(tmp_path / "none"), None, 0).latestOffset() == {}
    out = str(tmp_path / "out")
    event_log.write_sse(event_log.tail(spark, log, 1, 7), out, str(tmp_path / "check")).awaitTermination()
    assert sse_of(spark, out) == wanted_sse(spark, [r for r in rows if r[0] == 1 and r[1] > 7])


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(monitor.STATE_STORE)
    spark.conf.set(monitor.STATE_STORE, monitor.ROCKS_DB)
    yield
    spark.conf.set(monitor.STATE_STORE, before)


def streamed(spark, tmp_path, batches):
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = monitor.monitored(stream, **KINDS, delta=10.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    query.trigger(availableNow=True).start().awaitTermination()
    return monitor.final(spark.read.schema(monitor.OUTPUT).parquet(str(tmp_path / "out")))


def rows_of(df, *names):
    return sorted(str(tuple(sorted(v) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(*names).collect())


@pytest.mark.parametrize("sizes", [{1: 40, 2: 25, 3: 1}, {7: 200}])
def test_monitor_equals_the_batch_queries(spark, tmp_path, rocks, sizes):
    """Events dealt to micro-batches at random, so that many come before their predecessors; and one workflow that holds all."""
    rows, rng = log_of(len(sizes), sizes), random.Random(4)
    batches = [[] for _ in range(4)]
    for r in rows:
        rng.choice(batches).append(r)
    for b in batches:
        rng.shuffle(b)
    seen, progress, reports = streamed(spark, tmp_path, batches)
    log = frame(spark, rows)
    ordered = events.progress_rows(log, "work")
    assert rows_of(progress, "workflow_id", "step", "sequence", "percent") == rows_of(events.latest_progress(ordered), "workflow_id", "step", "sequence", "percent")
    assert rows_of(reports, "workflow_id", "step", "sequence", "percent") == rows_of(events.throttled(ordered, 10.0), "workflow_id", "step", "sequence", "percent")
    runs = log.select("workflow_id").distinct().withColumn("run_status", F.lit("running"))
    assert rows_of(events.statuses(seen, runs, 3), "workflow_id", "step", "status") == rows_of(events.step_status(log, runs, 3, "done", "error", "start"), "workflow_id", "step", "status")


def test_an_event_before_its_predecessor_waits(spark, tmp_path, rocks):
    rows = [(1, 3, "done", 1, None, 3), (1, 1, "start", 0, None, 1)]
    assert [tuple(r) for r in streamed(spark, tmp_path, [rows[:1], rows[1:]])[0].collect()] == [(1, [], None, 0)]


def test_a_timer_tells_of_a_stalled_step(spark, tmp_path, rocks):
    frame(spark, [(1, 1, "start", 2, None, 1), (2, 1, "note", None, None, 2)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    query = monitor.monitored(stream, **KINDS, stall_ms=200, keep_ms=3_600_000).writeStream.format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            got = spark.table("stalls").where("kind = 'stalled'").collect()
            if got:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.workflow_id, r.sequence, r.step) for r in got] == [(1, 1, 2)]
