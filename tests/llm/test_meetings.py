"""Meetings of large groups in near-dedup, against brute force, and what families of one template cost."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cueframe.llm import minhash

SCHEMA = "doc_id long, text string"


def family(rng, first, count, shared, own, letters=None):
    """Documents of ``shared`` words of one template and ``own`` of their own, which may come from few ``letters``."""
    base = [f"t{first}x{k}" for k in range(shared)]
    return [(first + d, " ".join(base + [f"o{first + d if letters is None else rng.randrange(letters)}x{k}" for k in range(own)])) for d in range(count)]


def members(spark, rows, k=1):
    texts = spark.createDataFrame(rows, SCHEMA)
    docs = texts.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("comp"))
    return texts, minhash._admissible(minhash._by_rare_shingle(docs, texts, k, minhash.SIMILAR), minhash.SIMILAR)


def classes(ids, links):
    root = {i: i for i in ids}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((up(a), up(b)))
        root[b] = a
    return {i: up(i) for i in ids}


def linked(rows):
    sets = [(d, set(t.split())) for d, t in rows]
    return [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 100 * len(x & y) >= 80 * len(x | y) and x & y]


@pytest.mark.parametrize("count", [300, 600])
def test_a_family_under_the_similarity_does_not_meet(spark, count):
    rows = family(random.Random(1), 0, count, 170, 30)
    assert members(spark, rows)[1].count() == 0


def test_late_members_meet_early_ones_alone(spark, monkeypatch):
    """A family of 120 late members with one early one: the copies grow with the members, not with their square."""
    monkeypatch.setattr(minhash, "BLOCK", 10)
    rows = family(random.Random(2), 0, 120, 170, 25) + [(900, " ".join(f"t0x{k}" for k in range(170)))]
    texts, met = members(spark, rows)
    groups = met.groupBy("pivot").agg(F.sum("meets").alias("copies"), F.count(F.lit(1)).alias("m")).collect()
    assert len(groups) == 1 and groups[0].m == 121 and groups[0].copies == 120 + 13
    links = [(r.a, r.b) for r in minhash._meeting(met, texts, 1, minhash.SIMILAR).collect()]
    assert classes([d for d, _ in rows], links) == classes([d for d, _ in rows], linked(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_meetings_lose_no_link(spark, monkeypatch, seed):
    """Families on both sides of the similarity, own words from few letters (so that they are shared too), sizes from one word on."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        shared = rng.randint(0, 40)
        rows += family(rng, 1000 * k, rng.randint(2, 14), shared, rng.randint(0 if shared else 1, 2 + shared // 4), rng.choice([None, 2, 3, 5]))
    # Documents that hold another's words and a few more, and two versions of one document.
    rows += [(50_000 + k, rows[3 * k][1] + "".join(f" extra{j}" for j in range(k % 9))) for k in range(25)]
    texts, met = members(spark, rows)
    links = [(r.a, r.b) for r in minhash._meeting(met, texts, 1, minhash.SIMILAR).collect()]
    truth = linked(rows)
    assert set(links) <= {tuple(sorted(x)) for x in truth}
    assert classes([d for d, _ in rows], links) == classes([d for d, _ in rows], truth)


def test_no_members(spark):
    texts, met = members(spark, [(1, "a b c")])
    assert met.count() == 0 and minhash._meeting(met, texts, 1, minhash.SIMILAR).count() == 0
