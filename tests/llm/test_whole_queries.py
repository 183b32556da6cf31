"""Every query of the subpackage, and each stage of the pipeline, over small tables with nulls, empty and equal texts and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from cueframe.llm import common, decontamination, line_dedup, matroska, registry

EXTRA = "1 AS c_gone, 2 AS keys, 3 AS lines, 4 AS kept, 5 AS score, 6 AS doc, 7 AS c0, 8 AS band, 9 AS part"
INSULTS = "idiot stupid moron scum pathetic loser trash vermin".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts():
    rng = random.Random(11)
    line = "This line stands in many of the documents, word for word."
    item = sentence(rng, 30)
    base = [sentence(rng, 60) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, "Ünïcode 日本 don't"), (6, base[0]), (7, base[0]), (8, base[0].replace(" ", "  ").upper()), (9, base[0].rsplit(" ", 2)[0]), (None, base[1]), (None, None)]
    rows += [(20 + k, f"{sentence(rng, 20)}\n{line}\n{sentence(rng, 5)}") for k in range(8)]
    rows += [(40, f"{base[2]} {item} {base[3]}"), (41, f"{base[4]} {item[:50]}#{item[51:]} {base[5]}"), (42, item[: len(item) // 2])]
    rows += [(100 + k, f"you {' '.join(rng.choices(INSULTS, k=6))} {sentence(rng, 15)}") for k in range(60)] + [(200 + k, sentence(rng, 25)) for k in range(120)]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    rows, item = texts()
    docs = [(d, t, None if d is None or d % 7 == 0 else ("de" if t and "ü" in t.lower() else "en"), "s", len(t or "")) for d, t in rows]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *EXTRA.split(", ")),
        "labels": spark.createDataFrame([(d, 1, int(100 <= d < 160)) for d, _ in rows if d and d >= 100] + [(None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.org/x", "<p>a<nav>m</nav><p>b &amp; c"), (2, None, None), (3, "", ""), (1, "http://a.org/x", "<p>a<nav>m</nav><p>b &amp; c"), (None, "http://a.org", "<b>d")], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS low", "3 AS key"),
        "benchmark": spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string").selectExpr("*", "1 AS doc_id"),
        "conversations": spark.createDataFrame([(1, 1, "assistant", "b\\<[\n"), (1, 0, "user", None), (2, 0, None, ""), (2, 0, None, ""), (3, 1, "system", "x")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS head"),
        "embeddings": spark.createDataFrame([(None, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, 0.5], None)] + [(k, [0.1 * (k % 9), 0.7 - 0.1 * (k % 5)], k % 2) for k in range(50, 120)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS key", "2 AS block", "3 AS rank"),
    }
    for name, frame in frames.items():
        frame.coalesce(2).write.parquet(f"{place}/{name}.parquet")
    return place


@pytest.fixture(scope="module")
def found(spark, tables):
    return lambda name: next(q for n, q in registry.QUERIES.items() if n.startswith(name + "_"))(spark, tables).collect()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text, k):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    said = [w for w in low.translate(bytes(32 if 9 <= c <= 13 else c for c in range(256))).split(b" ") if w]
    return {tuple(said[i : i + k]) for i in range(len(said) - k + 1)} if len(said) >= k else ({tuple(said)} if said else set())


def components(rows, k):
    """Each document's least reachable id, all pairs compared."""
    known = sorted((d, shingles(t, k)) for d, t in rows if d is not None)
    comp = {d: d for d, _ in known}
    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            if x & y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return comp


def test_queries_with_sql(found, tables):
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        # Two rows have no id; the SQL's groups would be one.
        want = con.execute(sql.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id IS NOT NULL) d")) if "documents" in sql else con.execute(sql)
        names = [c[0] for c in want.description]
        rows = [r for r in found(name.split("_")[0]) if "doc_id" not in names or r.doc_id is not None]
        assert sorted(names) == sorted(rows[0].__fields__)
        assert sorted(str(tuple(r[n] for n in names)) for r in rows) == sorted(map(str, want.fetchall()))


def test_op1_counts_bytes_and_removes_later_repeats(found):
    rows, _ = texts()
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in found("op1")}
    for d, t in rows:
        assert any((d, len((t or "").encode())) == (a, b) for a, b, _ in got)
    assert (7, len(rows[5][1]), len(rows[5][1])) in got and all(n == 0 for d, _, n in got if d is None)


def test_op3(found):
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found("op3")) == [("1", "a\nb & c", 7), ("1", "a\nb & c", 7), ("2", "", 0), ("3", "", 0), ("None", "d", 1)]


def test_op4_and_op6_hold_out_what_they_say(found):
    rows, _ = texts()
    ids = sorted(str(d) for d, _ in rows)
    four, six = found("op4"), found("op6")
    assert sorted(str(r.doc_id) for r in four) == ids and sorted(str(r.doc_id) for r in six) == ids
    for r in four:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in four if r.doc_id and r.doc_id >= 100 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id < 160) for r in held]) > 0.9
    for r in six:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.doc_id: r.lang_pred for r in six if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and {r.lang_pred for r in six} <= {"en", "de", "und"}


def test_op5(found):
    rows, _ = texts()
    by = {r.doc_id: r for r in found("op5") if r.doc_id is not None}
    for d, t in rows:
        if d is not None:
            data = matroska.padded((t or "").encode())
            r = by[d]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), digest(data), zlib.crc32(data[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(matroska.mux(data)), digest(matroska.mux(data)))
    assert by[1].feature == by[2].feature and by[6].media_sha256 == by[7].media_sha256


def test_op7(found):
    rows, _ = texts()
    comp = components(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found("op7") if r.doc_id is not None}
    assert got == {d: (len(shingles(t, 4)), comp[d], comp[d] == d) for d, t in rows if d is not None} and comp[9] == comp[8] == 6


def test_op9_finds_whole_items(found):
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found("op9")) == [(40, 1, 0), (40, 4, 0), (41, 1, 1), (41, 4, 1)]


def packed(pieces, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted([*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    line = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    # Concatenated and cut: every window but the last is full, and no id is left out.
    assert [p.sequence_id * 2048 + p.offset for p in line] == np.cumsum([0, *[p.length for p in line]])[:-1].tolist()
    assert all(p.length > 0 and p.offset + p.length <= 2048 for p in line) and sum(p.length for p in line) == sum(map(len, want))
    assert sorted(p.doc_tokens for p in line if p.start == 0) == sorted(map(len, want))


def test_op10(found):
    packed(found("op10"), texts()[0])


def test_each_stage_of_the_pipeline_does_its_whole_job(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(pipeline.STAGES)

    def run(name):
        nonlocal docs
        out = stages[name](spark, docs, tables)
        assert out.columns == names
        docs = common.materialize(out, name)
        return [(r.doc_id, r.text) for r in docs.collect()]

    key = lambda r: (str(r[0]), str(r[1]))
    toxic = run("toxicity")
    assert {d for d, _ in toxic} >= {d for d, _ in rows if d is None or d < 100 or d >= 200} and sum(1 for d, _ in toxic if d and 100 <= d < 160) <= 3
    lines: dict = {}
    for d, t in toxic:
        for k in {line_dedup._keys(x.encode(), 40)[0] for x in (t or "").split("\n")} - {None}:
            if d is not None:
                lines.setdefault(k, set()).add(d)
    gone = lambda d, x: d is not None and (k := line_dedup._keys(x.encode(), 40)[0]) is not None and len(lines[k]) >= 5 and max(lines[k]) != d
    want = [(d, "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in toxic]
    assert sorted(want, key=key) == sorted(kept := run("line_dedup"), key=key) and kept != toxic
    comp = components(kept, 5)
    assert sorted((r for r in kept if r[0] is None or comp[r[0]] == r[0]), key=key) == sorted(near := run("near_dedup"), key=key) and len(near) < len(kept)
    assert sorted((r for r in near if r[0] not in (40, 41)), key=key) == sorted(clean := run("decontamination"), key=key)
    packed(stages["packing"](spark, docs, tables).collect(), clean)


def test_index_of_nothing():
    assert decontamination.Index([]).regions(decontamination.codes("abc" * 9), np.zeros(1, np.int64)) == []
