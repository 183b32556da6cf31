"""Parsing loses nothing but what is odd itself; joins keep their rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cueframe.operators import content, models, units


def test_odd_segments_are_lost_alone(spark):
    rows = [
        (1, '["x", {"start": 1, "end": 2.5, "text": "a"}, null, 7, {"start": "0", "end": 1, "text": 5, "words": [3, {"text": "w", "start": 1.5, "confidence": "high"}]}]'),
        (2, '{"segments": [{"start": 0, "end": 1, "text": "b", "source_text": null}], "more": []}'),
        (3, "{cut"), (4, '"text"'), (5, None), (6, '{"segments": 5}'), (7, '[{"start": 0, "end": 1}] trailing'),
    ]
    got = units.decoded(spark.createDataFrame(rows, "key long, content string")).orderBy("key", "idx").collect()
    assert [(r.key, r.idx, r.start_ms, r.end_ms, r.text, r.valid) for r in got] == [(1, 0, 1000, 2500, "a", True), (1, 1, None, 1000, "", False), (2, 0, 0, 1000, "b", True)]
    assert [tuple(w) for w in got[1].words] == [("w", 1500, None, None)] and got[0].words is None


def test_replies_are_read_by_type(spark):
    good = '{"index": 0, "text": "a", "status": "uncertain", "uncertain_reason": "noise"}'
    cases = {
        f"[{good}]": None, '[{"index": 0, "text": "a", "status": null}]': None, '[{"index": 0, "text": 5}]': "text", '[{"index": 0, "text": "a", "uncertain_reason": 7}]': "reason",
        '[{"index": 0, "text": "a", "status": 7}]': "status", '[{"index": 0, "text": "a", "status": "odd"}]': "status", f"[{good}] trailing": "not an array", "{}": "not an array", "": "not an array",
        "[]": "count", f"[{good}, {good}]": "count", "[7]": "index", '[{"index": "0", "text": "a"}]': "index", '[{"index": 0.5, "text": "a"}]': "index", '[{"index": true, "text": "a"}]': "index", '[{"text": "a"}]': "index",
    }
    rows = spark.createDataFrame([(k, reply, 1) for k, reply in enumerate(cases)] + [(99, "[]", 0), (98, None, 1)], "key long, reply string, expected int")
    got = {r.key: r for r in content.parsed_replies(rows).collect()}
    assert [got[k].problem for k in range(len(cases))] == list(cases.values())
    assert got[99].problem is None and got[99]["items"] == [] and got[98].problem == "not an array"
    assert [tuple(x) for x in got[0]["items"]] == [(0, "a", "uncertain", "noise")]


def test_odd_models_are_lost_alone(spark):
    rows = [
        ("p", '{"data": [5, {"id": 5}, {"id": ""}, {"id": "m", "name": 3, "context_length": "9", "top_provider": {"context_length": 8}}, {"id": "m", "name": "again"}, {"id": "n", "context_length": 4}]}'),
        ("q", "[]"), ("r", '{"data": {}}'), ("s", "{"), ("t", '{"data": []}'),
    ]
    frame = spark.createDataFrame(rows, "provider string, payload string")
    assert sorted(tuple(r) for r in content.provider_models(frame).collect()) == [("p", 3, "m", None, 8), ("p", 5, "n", None, 4)]
    assert {tuple(r) for r in content.provider_problems(frame).collect()} == {("q", "not an object"), ("r", "no data array"), ("s", "not an object")}


def test_a_run_without_a_state_is_pending(spark):
    runs = spark.createDataFrame([(1, 10), (2, 20)], "run_id long, workflow_id long")
    states = spark.createDataFrame([(10, "completed")], "workflow_id long, status string")
    log = spark.createDataFrame([(10, 4)], "workflow_id long, sequence long")
    now = datetime.datetime(2024, 1, 1)
    assert sorted(tuple(r) for r in models.run_sync(runs, states, log, F.lit(now)).collect()) == [(1, 10, "completed", now, 4), (2, 20, "pending", None, 0)]


def test_tools_bind_by_kind_without_a_nested_loop(spark):
    tools = spark.createDataFrame([("t", "in", ["a", "b", "a"], True), ("u", "in", ["z"], True), ("v", "in", [], False)], "tool string, input string, kinds array<string>, required boolean")
    outputs = spark.createDataFrame([(1, 0, "s1", "x", "a"), (2, 0, "s2", "y", "b"), (2, 1, "s2", "z", "a")], "step_place int, place int, step_id string, name string, kind string")
    found = models.bound_tools(tools, outputs)
    assert [tuple(r) for r in found.collect()] == [("t", "in", "s2.y")]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
