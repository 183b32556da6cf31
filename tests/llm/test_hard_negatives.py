"""The dual-tree search against brute force and its SQL."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from cueframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    clean = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in clean:
            clean.append(row)
    out = []
    for anchor, label, v in clean:
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in clean if i != anchor)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            kept = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(anchor, positive, k, n, -s, -t) for k, (t, n, _) in enumerate(kept, 1)]
    return sorted(out)


def got(frame):
    return sorted(map(tuple, frame.collect()))


def clustered(seed, n, dims, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.6, (6, dims))
    return [(i, (centers[rng.integers(6)] + rng.normal(0, 0.2, dims)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture()
def fine(monkeypatch):
    """Small blocks, leaves and chunks, so that little data makes many."""
    for name, value in {"LEAST_BLOCK": 64, "SAMPLE": 100, "LEAF": 8, "ANCHOR_LEAF": 2, "CHUNK": 3, "STRIDE": 16}.items():
        monkeypatch.setattr(hn, name, value)


@pytest.mark.parametrize(("n", "dims"), [(700, 8), (260, 64), (3, 2), (1, 1)])
def test_equals_brute_force(spark, fine, n, dims):
    rows = clustered(n, n, dims)
    assert got(hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_rows(spark, fine):
    nan, inf = float("nan"), float("inf")
    odd = [(50, None, 1), (100, [1.0, None, 0.0], 1), (150, [nan, 0.0, 0.0], 1), (200, [inf, 0.0, 0.0], 1), (250, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 1), (300, [], 1), (350, [0.5], 1), (400, [0.0, 0.0, 0.0], 2)]
    rows = odd + [(i, [0.3, 0.1 * (i % 3), -0.2], i % 3) for i in range(1, 40)] + [(0, [0.3, 0.1, -0.2], 1)] * 3 + [(-50, [0.25, 0.5, -0.25], 2), (50, [0.5, 0.5, 0.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS block", "3 AS vec", "4 AS rank").repartition(4)
    assert got(hn.mine(frame)) == brute(rows)
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame(odd[:3], SCHEMA)).count() == 0


def test_a_third_of_all_rows_are_one_vector(spark, fine):
    rng = random.Random(2)
    rows = [(i, [0.5, 0.5, 0.1, 0.0] if i % 3 == 0 else [round(rng.uniform(-1, 1), 2) for _ in range(4)], i % 2) for i in range(600)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5], 1)] * 200
    assert got(hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_scores_stay_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert hn.scores(a, a).tolist() == [[hn.TOP, 2**40 + 3], [2**40 + 3, 2]]
    b = np.array([[2.0**30 + 1, 2.0**30 - 1]])
    assert hn.scores(b, b).tolist() == [[2 * 2**60 + 2]]


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(4)
    far = np.concatenate([rng.normal(s, 5, (200, 6)) for s in (-400, 0, 400)]).round()
    ids, labels = np.arange(600), np.zeros(600, np.int64)
    tree, near = hn.Tree.build(far, labels, 20), hn.Tree.build(far[500:540], labels[500:540], 4)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(near.left)), np.arange(len(tree.left)), indexing="ij"))
    low, high = hn.intervals(near, tree, i, j)
    for k in range(0, len(i), 7):
        s = far[500:540][near.order[near.first[i[k]] : near.past[i[k]]]] @ far[tree.order[tree.first[j[k]] : tree.past[j[k]]]].T
        assert low[k] <= s.min() and s.max() <= high[k]
    wants = hn.Wants.make(True, 5, np.full((40, 1), -hn.TOP), np.full((40, 1), hn.TOP))
    rows = hn.Points(ids, labels, far)
    scored = hn.search(hn.Points(ids[500:540], labels[500:540], far[500:540]), near, rows, tree, wants)
    again = hn.search(hn.Points(ids[500:540], labels[500:540], far[500:540]), near, rows, tree, wants)
    assert again < 40 * 260 and scored <= 40 * 600


def test_query_equals_its_sql(spark, small):
    from cueframe.llm.registry import ORACLE_SQL, QUERIES

    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
        wanted = sorted(con.execute(ORACLE_SQL["op13_hard_negatives"]).fetchall())
    assert len(wanted) > 20
    assert got(QUERIES["op13_hard_negatives"](spark, small)) == wanted
