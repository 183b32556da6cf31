"""What a stream asks of its state store and of its log's folder for each batch."""

from __future__ import annotations

import pandas as pd

from cueframe.streaming import event_log, monitor


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*of):
            self.calls.append(name)
            if name == "update":
                self.value = of[0]
            return {"get": self.value, "exists": self.value is not None, "keys": iter(())}.get(name)

        return call


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *of):
        return State(self.calls)

    getMapState = getValueState


def test_a_batch_of_a_workflow_is_three_calls():
    """Each step took up to four calls, each a round trip."""
    handle, made = Handle(), monitor.Monitor("done", "error", "start", "work", 10.0, None, None)
    made.init(handle)
    events = [(k + 1, kind, k % 6, 10.0 * k if kind == "work" else None) for k, kind in enumerate(["start", "work", "done"] * 6)]
    for batch in (events[:9], events[9:]):
        handle.calls.clear()
        list(made.handleInputRows((1,), iter([pd.DataFrame(batch, columns=["sequence", "type", "step", "percent"])]), None))
        assert len(handle.calls) == 3
    at, failed, started, done, steps, percents = made.head.value
    assert (at, failed, started, done) == (19, None, 3, [2, 5]) and dict(zip(steps, percents, strict=True)) == {1: 100.0, 4: 100.0}


def test_a_batch_lists_the_log_once(tmp_path, monkeypatch):
    (tmp_path / "workflow=1").mkdir()
    (tmp_path / "workflow=1" / "1-3.jsonl").write_text("")
    reader, listings = event_log.TailReader(str(tmp_path), None, 0), []
    listed = event_log.listed
    monkeypatch.setattr(event_log, "listed", lambda path: listings.append(path) or listed(path))
    assert reader.latestOffset() == {"1": 3}
    assert [len(p.files) for p in reader.partitions({}, {"1": 3})] == [1] and len(listings) == 1
    assert [len(p.files) for p in reader.partitions({}, {"1": 3})] == [1] and len(listings) == 2


def test_a_tail_of_all_workflows_holds_no_workflow_on_the_driver(spark, tmp_path):
    """The offset had an entry for each workflow, and the driver listed all segments."""
    columns = "workflow_id long, sequence long, type string, step int, percent double, event_id long"
    log, checks = str(tmp_path / "log"), []
    for size in (3, 300):
        event_log.append_log(spark.createDataFrame([(w + 1000 * size, k, "note", None, None, w) for w in range(size) for k in (1, 2, 3)], columns), f"{log}-{size}", 2)
        checks.append(tmp_path / f"check-{size}")
        event_log.write_sse(event_log.tail(spark, f"{log}-{size}"), str(tmp_path / f"out-{size}"), str(checks[-1])).awaitTermination()
    small, large = ((c / "offsets" / "0").stat().st_size for c in checks)
    assert large < small + 100
    assert len(list((tmp_path / "log-300" / "_segments").glob("part-*"))) <= 4
    assert len(list((tmp_path / "out-300").rglob("*.sse"))) == 300


def test_a_log_without_an_index_gets_one_and_gaps_wait_in_the_tail(spark, tmp_path):
    columns = "workflow_id long, sequence long, type string, step int, percent double, event_id long"
    log, row = str(tmp_path / "log"), lambda w, k: (w, k, "note", None, float("nan"), k)
    (tmp_path / "log" / "workflow=5").mkdir(parents=True)
    (tmp_path / "log" / "workflow=5" / "1-2.jsonl").write_text('{"workflow_id":5,"sequence":1,"type":"note","event_id":1}\n{"workflow_id":5,"sequence":2,"type":"note","event_id":2}\n')

    def seen(wait):
        stream = event_log.tail(spark, log, wait=wait).writeStream.format("parquet").option("path", str(tmp_path / f"out-{wait}")).option("checkpointLocation", str(tmp_path / f"check-{wait}"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.workflow_id, r.sequence) for r in spark.read.schema(columns).parquet(str(tmp_path / f"out-{wait}")).collect())

    assert seen(True) == [(5, 1), (5, 2)]
    event_log.append_log(spark.createDataFrame([row(5, k) for k in (5, 6)] + [row(6, 1)], columns), log, 2)
    assert seen(True) == [(5, 1), (5, 2), (6, 1)] and seen(False) == [(5, 1), (5, 2), (5, 5), (5, 6), (6, 1)]
    event_log.append_log(spark.createDataFrame([row(5, k) for k in (3, 4)], columns), log, 2)
    assert seen(True) == seen(False) == [(5, k) for k in range(1, 7)] + [(6, 1)]
