"""The conversation trie against a brute-force trie and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cueframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    members, ended = defaultdict(set), defaultdict(list)
    for c in own:
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(t[2:] for t in own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ended[path].append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        childless = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        children = sum(len(m) == len(node) + 1 for m in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        listed = ",".join(map(str, sorted(ended.get(node, []))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, len(childless), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return Counter(out)


def got(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def made(seed, convs, unique=False):
    """Few roles and texts, so that many prefixes are shared; nulls, gaps in the turns and missing bases."""
    rng, rows = random.Random(seed), []
    for c in convs:
        for t in rng.sample(range(12), rng.randint(1, 8)):
            rows.append((c, t if t or unique else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", "", None, "日本é"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs"), [(1, range(60)), (2, [*range(95, 130), 250, 251, 1002, 1001]), (3, [-250, -99, -7, -1, 0, 1, 3, 99, 100]), (4, [5])])
def test_equals_brute_force(spark, seed, convs):
    rows = made(seed, convs)
    frame = spark.createDataFrame([*rows, (None, 1, "user", "x")], SCHEMA).selectExpr("*", "1 AS base", "2 AS digest", "3 AS path", "4 AS n", "5 AS parent").repartition(5)
    assert got(prefix_trie.trie(frame)) == brute(rows)


def test_equal_conversations_and_small_tables(spark, monkeypatch):
    """A very common conversation over many families, with tables that go out early, broadcast parents, and paths in many pieces."""
    monkeypatch.setattr(prefix_trie, "NODES", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 2)
    rows = [(c, t, "user", f"common {t}") for c in range(0, 700, 2) for t in range(6)] + made(9, range(1, 60, 2), True)
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)
    monkeypatch.setattr(prefix_trie, "BROADCAST_IDS", 0)
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_turnless_and_no_rows(spark):
    h = {c: prefix_trie.heads(c) for c in range(101, 200)}
    lone = next(c for c in h if h[c] >= 2)
    rows = [(lone, 0, "user", "one"), (lone, 1, "user", "two")]
    assert [tuple(r)[1:] for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_and_repeats_have_one_result(spark):
    rows = [(100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "b"), (100, None, None, None), (200, 0, "user", "a")]
    frames = [prefix_trie.trie(spark.createDataFrame(r, SCHEMA).repartition(n)) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert got(frames[0]) == got(frames[1])
    assert sum(got(frames[0]).values()) == 6


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "NODES", 100)
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, t, "user", "x" * (t % 3)) for c, n in ((0, 3000), (3, 2500), (7, 40)) for t in range(n)]
    by = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(by) == 3001
    shared = sum((3 if d <= 40 else 2 if d <= 2500 else 1) * 1 * ((d - 1) % 3) - ((d - 1) % 3) for d in range(1, 3001))
    assert by[0, 0].saved_tokens == shared and by[0, 0].n_leaves == 1
    assert by[0, 41].saved_tokens == sum((d - 1) % 3 for d in range(41, 2501))


def test_query_equals_its_sql(spark, small):
    from cueframe.llm.registry import ORACLE_SQL, QUERIES

    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
        cursor = con.execute(ORACLE_SQL["op11_prefix_trie"])
        names = [d[0] for d in cursor.description]
        assert names == list(COLUMNS)
        assert got(QUERIES["op11_prefix_trie"](spark, small)) == Counter(map(tuple, cursor.fetchall()))
