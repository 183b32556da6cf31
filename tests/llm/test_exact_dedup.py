"""Suffix and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cueframe.llm import line_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, pid int, start string, spans string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "xx", 1, "s", "p") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def suffix_truth(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - suffix_dedup.LENGTH + 1):
            window = data[s : s + suffix_dedup.LENGTH]
            if window in seen:
                gone[s : s + suffix_dedup.LENGTH] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rng = random.Random(3)
    a, b, c = words(rng, 60), words(rng, 40), words(rng, 30)
    rows = [(9, None), (8, ""), (7, "short"), (1, a), (2, words(rng, 5) + " " + a[40:260] + words(rng, 9)), (3, a), (4, b + c + b + c[:150] + b), (5, "ab " * 200), (6, "ab " * 90)]
    rows += [(20 + k, words(rng, k) + c + words(rng, 3)) for k in range(12)]
    # One frequent anchor in many contexts, and matches that are one byte too short or long enough.
    core = words(rng, 8)[:40]
    rows += [(40 + k, words(rng, 12) + core + words(rng, 12)) for k in range(40)]
    rows += [(90, a[100:199]), (91, "x" + a[100:200] + "y"), (92, a[30:330].replace(a[200:210], "##########"))]
    rng.shuffle(rows)
    return rows


def test_suffix_dedup_removes_what_brute_force_removes(spark):
    rows = passages()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.removed(frame(spark, rows).repartition(3), digest=True).collect()}
    assert got == suffix_truth(rows)


def test_frequent_anchors_and_keys_are_not_gathered_and_change_nothing(spark):
    rng = random.Random(8)
    core = words(rng, 30)
    # One passage in many contexts, some of which repeat on one side.
    sides = [words(rng, 12) for _ in range(4)]
    rows = [*passages(), *[(200 + k, f"{sides[k % 4]} {k % 3} {core} {k % 5} {sides[k % 3]}") for k in range(40)]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.removed(frame(spark, rows).repartition(2), digest=True, many=2, most_rows=3).collect()}
    assert got == suffix_truth(rows)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.removed(frame(spark, [])).count() == 0


def test_suffix_dedup_of_rows_without_an_id(spark):
    text = words(random.Random(1), 60)
    got = {(r.doc_id, r.n_removed > 0) for r in suffix_dedup.removed(frame(spark, [(None, text), (None, text), (5, text), (6, text)])).collect()}
    assert got == {(None, False), (5, False), (6, True)}


def test_versions_of_one_document_are_not_earlier_than_each_other(spark):
    text = words(random.Random(1), 60)
    assert [r.n_removed for r in suffix_dedup.removed(frame(spark, [(5, text), (5, text)])).collect()] == [0, 0]


def test_long_texts_are_taken_in_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr("cueframe.llm.common.CHUNK_BYTES", 300)
    rng = random.Random(5)
    a = words(rng, 300)
    raw = np.frombuffer((a + a[500:900]).encode(), np.uint8)
    whole = suffix_dedup.runs(raw, np.array([0, len(raw)]))
    parts = []
    for k in range(0, len(raw) - suffix_dedup.LENGTH + 1, 700):
        piece = raw[k : k + 700 + suffix_dedup.LENGTH - 1]
        row, start, size, off, anchor, _ = suffix_dedup.runs(piece, np.array([0, len(piece)]))
        parts += [(s + k + j, h, s + k + o) for s, n, o, h in zip(start, size, off, anchor, strict=True) for j in range(n)]
    _, start, size, off, anchor, _ = whole
    assert parts == [(s + j, h, s + o) for s, n, o, h in zip(start, size, off, anchor, strict=True) for j in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sorts_and_knows_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    strings = rng.integers(97, 99, (60, 80)).astype(np.uint8)
    strings[10:40, : 20 + 15 * seed] = strings[10, : 20 + 15 * seed]
    strings[20:25] = strings[20]
    key = rng.integers(0, 2, 60)
    order, shared = suffix_dedup.deep_shallow(key, strings)
    rows = [(int(key[i]), strings[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for k in range(60):
        if k == 0 or rows[k][0] != rows[k - 1][0]:
            assert shared[k] == -1
        else:
            a, b = rows[k - 1][1], rows[k][1]
            assert shared[k] == next((j for j in range(80) if a[j] != b[j]), 80)


def line_truth(rows, min_docs=5):
    def key(line):
        k = line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return k if len(k) >= 40 else None

    docs = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                docs.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(docs[key(x)]) >= min_docs and doc != max(docs[key(x)]))]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_rows():
    long = ["Ünd so weiter " * 4, "The same line again and again and again, " * 2, "x" * 39, "y" * 40, "É" * 40]
    rows = [(k, "\n".join([f"only here {k}", long[k % 5], "  " + long[(k + 1) % 5].upper() + "\t", long[k % 5], "", "tail"])) for k in range(25)]
    return [*rows, (99, None), (98, ""), (97, "\n"), (96, long[1] + "\r\n" + long[3] + "\x0b")]


def test_line_dedup_matches_brute_force(spark):
    rows = line_rows()
    docs = frame(spark, rows)
    out = line_dedup.dedup_lines(docs, batches=5, fanout=2)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {d: x[2] for d, x in line_truth(rows).items()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]
    clash = docs.selectExpr("1 AS keys", "doc_id", "2 AS of", "text", "3 AS doc", "'k' AS kept", "5 AS lines", "6 AS c0", "7 AS key", "8 AS last_doc")
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns
    assert {(r.doc_id, r.text, r["keys"], r["kept"], r["c0"]) for r in out.collect()} == {(d, x[2], 1, "k", 6) for d, x in line_truth(rows).items()}
    counted = line_dedup._deduped(docs.select("doc_id", "text"), ["doc_id"], False, 40, 5, 4, 3)
    assert {r.doc_id: (r["lines"], r["dropped"], r["kept"]) for r in counted.collect()} == line_truth(rows)


def test_line_runs_say_what_is_new_and_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    batch = lambda *rows: spark.createDataFrame([(d, k.encode()) for d, k in rows], "doc_id long, key binary")
    runs.add(batch((1, "a"), (2, "a"), (2, "b")))
    runs.add(batch((7, "a"), (8, "c")))
    runs.add(batch((9, "c"), (3, "d")))
    assert [len(level) for level in runs.levels] == [1, 1]
    last = {bytes(r.key): r.fresh for r in runs._rows(runs.levels[0][0]).collect()}
    assert last == {b"c": False, b"d": True}
    assert {bytes(r.key): r.last_doc for r in runs.common(2).collect()} == {b"a": 7, b"c": 9}


def test_a_later_job_goes_on_with_the_runs(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame([(d, k.encode()) for d, k in rows], "doc_id long, key binary")
    first = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    first.add(batch((1, "a"), (2, "a"), (2, "b")))
    first.save(str(tmp_path / "runs"))
    for name in first.runs():
        spark.sql(f"DROP TABLE {name}")  # the next session's catalog does not know it; its files stay
    later = line_dedup.LineRuns.opened(spark, str(tmp_path / "runs"))
    later.add(batch((5, "a"), (6, "e")))
    assert [len(level) for level in later.levels] == [0, 1]
    assert {bytes(r.key): r.last_doc for r in later.common(3).collect()} == {b"a": 5}
    later.drop()
    assert not later.runs() and not [t for t in spark.catalog.listTables() if t.name.startswith(later.prefix)]


def test_common_lines_come_from_fresh_keys_and_what_was_added(spark):
    rng = random.Random(5)
    runs, docs = line_dedup.LineRuns(spark, fanout=3, buckets=2), {}
    for _ in range(5):
        rows = {(rng.randint(0, 500), f"k{rng.randint(0, 60)}") for _ in range(40)}
        for d, k in rows:
            docs.setdefault(k.encode(), []).append(d)
        runs.add(spark.createDataFrame([(d, k.encode()) for d, k in rows], "doc_id long, key binary"))
    for least in (1, 2, 4, 99):
        got = sorted((bytes(r.key), r.last_doc) for r in runs.common(least).collect())
        assert got == sorted((k, max(d)) for k, d in docs.items() if len(d) >= least)
    plan = runs.common(2)._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT fresh" in plan


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
