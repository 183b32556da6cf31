"""Keyed tables, bindings from step runs, and workflow graphs."""

from __future__ import annotations

import random

import pytest

from cueframe.operators import artifacts, graphs, upserts

SCHEMA = "id long, kind string, at int, made int, note string"
KEYS = ["id", "kind"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_match_a_dictionary_and_rewrite_only_what_they_touch(spark, tmp_path):
    rng, path, state = random.Random(5), str(tmp_path / "table"), {}
    upserts.created(path, spark.createDataFrame([], SCHEMA).schema, KEYS, 16)
    assert rows_of(upserts.read(spark, path)) == []
    seen = []
    for n in (60, 40, 1):
        batch = [(rng.choice([None, *range(30)]), rng.choice(["a", None]), rng.randint(0, 9), rng.randint(0, 99), rng.choice(["x", None, "y"])) for _ in range(n)]
        batch += [(1, "a", k, k, "hot") for k in range(n)]
        ordered = sorted(batch, key=lambda r: (r[2], r[3], r[4] is not None, r[4]))
        firsts = {}
        for r in ordered:
            firsts.setdefault(r[:2], r[3])
        new = {r[:2]: r for r in ordered}
        for k, r in new.items():
            state[k] = (*r[:3], state[k][3] if k in state else firsts[k], r[4])
        before = set(upserts.read(spark, path).inputFiles())
        now = upserts.upsert(spark.createDataFrame(batch, SCHEMA), path, ["at"], ["made"])
        after = set(upserts.read(spark, path).inputFiles())
        assert rows_of(upserts.read(spark, path)) == sorted(state.values(), key=repr)
        seen.append((now.number, sorted(state.values(), key=repr), len(before), len(before & after), len(new)))
    # Two keys at most in the last batch: all other files are those of before.
    assert seen[2][3] >= seen[2][2] - 2 and seen[2][3] > 5
    for number, rows, *_ in seen:
        assert rows_of(upserts.read(spark, path, number)) == rows
    wanted = spark.createDataFrame([(1, "a"), (None, None), (99, "b")], "id long, kind string")
    got = upserts.lookup(wanted, path)
    assert rows_of(got) == sorted((r for k, r in state.items() if k in ((1, "a"), (None, None))), key=repr)
    assert len(got.inputFiles()) <= 3
    assert upserts.upsert(spark.createDataFrame([], SCHEMA), path, ["at"]).number == 3


def test_a_failed_upsert_leaves_the_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    upserts.created(path, spark.createDataFrame([], SCHEMA).schema, KEYS, 4)
    upserts.upsert(spark.createDataFrame([(1, "a", 1, 1, "x")], SCHEMA), path, ["at"])

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(upserts, "_commit", lost)
        with pytest.raises(OSError):
            upserts.upsert(spark.createDataFrame([(1, "a", 2, 2, "y")], SCHEMA), path, ["at"])
    assert rows_of(upserts.read(spark, path)) == [(1, "a", 1, 1, "x")]
    upserts.upsert(spark.createDataFrame([(1, "a", 3, 3, "z")], SCHEMA), path, ["at"])
    assert rows_of(upserts.read(spark, path)) == [(1, "a", 3, 3, "z")]


def test_tables_refuse_what_they_cannot_hold(spark, tmp_path):
    with pytest.raises(ValueError, match="c_bucket"):
        upserts.created(str(tmp_path / "t"), spark.createDataFrame([], "id int, C_bucket int").schema, ["id"], 4)
    with pytest.raises(ValueError, match="no column"):
        upserts.created(str(tmp_path / "t"), spark.createDataFrame([], "id int").schema, ["key"], 4)
    with pytest.raises(ValueError, match="no such table"):
        upserts.snapshot(str(tmp_path / "none"))


def test_run_bindings(spark):
    rows = [
        (1, 0, "completed", "a", [("text", 1, 1), ("srt", 2, 1)]),
        (1, 1, "failed", "a", [("text", 1, 2)]),
        (1, 2, "completed", "a", [("text", 1, 3)]),
        (1, 3, "completed", None, [("text", 9, 9)]),
        (2, 0, "completed", "a", [("text", 5, 1), ("text", 4, 1)]),
        (2, 1, None, "b", [("text", 7, 1)]),
        (3, 0, "completed", "a", None),
    ]
    step_runs = spark.createDataFrame(rows, "workflow_id long, position int, status string, step_id string, outputs array<struct<name string, artifact_id long, version long>>")
    assert rows_of(artifacts.run_bindings(step_runs)) == [(1, "a.srt", 2, 1), (1, "a.text", 1, 3), (2, "a.text", 4, 1)]


STEPS = "workflow_id long, place int, step_id string, outputs array<string>"
INPUTS = "workflow_id long, place int, name string, value string"


def test_problems_of_references(spark):
    steps = [(1, 0, "a", ["text"]), (1, 1, "b", ["srt"]), (1, 2, "c", None), (1, 3, "a", ["text"]), (2, 0, "b", ["text"])]
    inputs = [
        (1, 1, "ok", "b.srt.x"), (1, 1, "self", "b.srt"), (1, 2, "good", "b.srt"), (1, 2, "lost", "z.text"), (1, 0, "later", "b.srt"), (1, 2, "output", "b.text"),
        (1, 1, "project", "project.x"), (1, 1, "plain", None), (1, 3, "none", "c.text"), (2, 0, "other", "a.text"), (1, 1, "line", "b.srt\n"),
    ]
    got = rows_of(graphs.problems(spark.createDataFrame(steps, STEPS), spark.createDataFrame(inputs, INPUTS)))
    assert got == sorted(
        [(1, 3, None, "repeated step"), (1, 1, "self", "self-reference"), (1, 2, "lost", "unknown step"), (1, 0, "later", "forward reference"), (1, 2, "output", "unknown output"), (1, 3, "none", "unknown output"), (2, 0, "other", "unknown step")], key=repr
    )


def test_stale_steps_over_long_chains(spark):
    graph = [(1, k, k + 1) for k in range(12)] + [(1, 0, 5), (2, 0, 1), (2, 1, 2), (3, 4, 5)]
    changed = [(1, 3), (1, 3), (2, 1), (9, 0)]
    got = graphs.stale(spark.createDataFrame(graph, "workflow_id long, source int, place int"), spark.createDataFrame(changed, "workflow_id long, place int"))
    assert rows_of(got) == sorted([(1, k, k - 3) for k in range(3, 13)] + [(2, 1, 0), (2, 2, 1), (9, 0, 0)], key=repr)


def test_edges_that_can_find_nothing_new_go(spark):
    """Each round read the whole graph and all steps found before."""
    import glob
    import os

    graph = [(1, k, k + 1) for k in range(6)] + [(2, k, k + 1) for k in range(500)] + [(3, 1, 0), (3, 0, 1)]
    changed = [(1, 0), (3, 0)] + [(2, k) for k in range(501)]
    graphs.stale(spark.createDataFrame(graph, "workflow_id long, source int, place int"), spark.createDataFrame(changed, "workflow_id long, place int"))
    newest = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/stale-*"), key=os.path.getmtime)
    assert [spark.read.parquet(p).count() for p in sorted(glob.glob(f"{newest}/left/*"))] == [7, 5, 4, 3, 2, 1, 0]
