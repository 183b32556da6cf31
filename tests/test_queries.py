"""Every query that has SQL gives the SQL's rows; edge cases of the operators."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cueframe.functions import text, timecode
from cueframe.functions.text import Rule
from cueframe.io_oracle import ORACLE_SQL as IO_SQL
from cueframe.io_queries import QUERIES as IO_QUERIES
from cueframe.model_oracle import ORACLE_SQL as MODEL_SQL
from cueframe.model_queries import QUERIES as MODEL_QUERIES
from cueframe.operators import artifacts, catalog, content, events, models, quality, segmentation, translation, units
from cueframe.oracle import ORACLE_SQL as BASE_SQL
from cueframe.plans.steps import Step, chained
from cueframe.queries import QUERIES as BASE_QUERIES
from cueframe.state_oracle import ORACLE_SQL as STATE_SQL
from cueframe.state_queries import QUERIES as STATE_QUERIES
from cueframe.streaming import tail

QUERIES, ORACLE_SQL = BASE_QUERIES | MODEL_QUERIES | IO_QUERIES | STATE_QUERIES, BASE_SQL | MODEL_SQL | IO_SQL | STATE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = [tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(plain(r[c]) for c in order)) for r in df.collect())


def test_every_query_but_the_diff_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"unified_diff"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words_of(spark, *said):
    return spark.createDataFrame([(1, i, s, e, w) for i, (s, e, w) in enumerate(said)], "conv_id long, i long, start_ms long, end_ms long, word string")


def test_a_pause_and_a_sentence_mark_end_blocks(spark):
    words = words_of(spark, (0, 500, "Hello"), (500, 1100, "there."), (2000, 2400, "General"), (2400, 2800, "view"))
    got = segmentation.materialized(segmentation.blocks(words)).orderBy("block").collect()
    assert [(r.id, r.text, r.cps) for r in got] == [("seg_0001", "Hello there.", 10.909), ("seg_0002", "General view", 15.0)]


def test_short_blocks_merge_forward_then_back(spark):
    profile = segmentation.Profile(merge=True)
    words = words_of(spark, (0, 200, "Oh."), (300, 900, "Well."), (1000, 1100, "No."))
    assert [r.text for r in segmentation.blocks(words, profile).orderBy("block").collect()] == ["Oh. Well. No."]


def test_a_protected_term_stays_in_one_block(spark):
    profile = segmentation.Profile(chars=8, lines=1)
    words = words_of(spark, (0, 100, "see"), (100, 200, "Open"), (200, 300, "Source"), (300, 400, "now"))
    rules = [Rule("open source", protected=True)]
    assert "see Open Source" in [r.text for r in segmentation.blocks(words, profile, rules).collect()]
    assert "Source now" in [r.text for r in segmentation.blocks(words, segmentation.Profile(chars=10, lines=1)).collect()]


def test_text_functions(spark):
    assert one(spark, text.wrapped(F.lit("aaa bbb ccc ddd eee"), 7, 2)) == "aaa bbb\nccc ddd eee"
    assert one(spark, text.glossary(F.lit("Cost $5 and ÉTÉ"), [Rule("été", "su$m\\er", case_sensitive=False)])).startswith("Cost $5 and su$m")
    assert one(spark, text.size_label(F.lit(1536))) == "1.5KB" and one(spark, text.size_label(F.lit(0))) is None and one(spark, text.size_label(F.lit(12))) == "12.0B"
    assert one(spark, timecode.srt_time(F.lit(360_000_123))) == "100:00:00,123"
    assert one(spark, timecode.clamped_percent(F.lit("x"))) == 0.0 and one(spark, timecode.clamped_percent(F.lit(float("nan")))) == 0.0
    with pytest.raises(ValueError):
        Rule.of({"source": "a", "find": "b", "target": "c"})


def test_previews_cut_no_character(spark):
    for size in range(1, 12):
        shown, cut = artifacts.preview(F.lit("aéb€c𝄞d"), size)
        row = spark.range(1).select(shown.alias("s"), cut.alias("c")).first()
        assert row.s == "aéb€c𝄞d".encode()[:size].decode(errors="ignore") and row.c


def test_translation_halves_chunks_retries_and_resumes(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(4)], "key long, idx long, text string")
    asked = []

    def client(message, log=asked):
        import json

        items = json.loads(message)
        log.append(len(items))
        return json.dumps([{"index": x["index"], "text": x["text"].upper()} for x in (items[:-1] if len(items) == 4 else items)])

    assert translation.ask(client, [(i, f"t{i}") for i in range(4)]) == {i: f"T{i}" for i in range(4)} and asked == [4, 2, 2]
    done = spark.createDataFrame([(1, 0, "kept")], "key long, idx long, text string")
    assert {r.idx: r.text for r in translation.translate(rows, translation.Prefixing("x"), 2, done).collect()} == {0: "kept", 1: "[x] t1", 2: "[x] t2", 3: "[x] t3"}
    with pytest.raises(ValueError, match="1/0"):
        translation.completed(rows, lambda message: "[]", rounds=1)


def test_throttle_compares_with_the_last_report_passed(spark):
    rows = spark.createDataFrame([(1, 0, k, p) for k, p in enumerate((0.0, 42.4, 42.8, 43.3, 100.0, 100.0))], "workflow_id long, step int, sequence long, percent double")
    assert [r.percent for r in events.throttled(rows).orderBy("sequence").collect()] == [0.0, 42.4, 100.0]


def test_throttle_looks_at_label_phase_and_attempt(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, 0, 10.0, "p", "a"), (1, 0, 1, 1, 10.2, "p", "a"), (1, 0, 1, 2, 10.3, "p", "b"), (1, 0, 1, 3, 10.4, "q", "b"), (1, 0, 2, 4, 10.4, "q", "b"), (1, 0, 2, 5, 10.5, "q", "b")],
        "workflow_id long, step int, attempt int, sequence long, percent double, phase string, label string",
    )
    assert sorted(r.sequence for r in events.throttled(rows).collect()) == [0, 2, 3, 4]
    assert {(r.attempt, r.phase, r.sequence) for r in events.latest_progress(rows).collect()} == {(1, "p", 2), (1, "q", 3), (2, "q", 5)}


def test_lines_end_as_unicode_has_it(spark):
    for said in ("", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x85e\u2028f", "\n\n", "a\r\n"):
        got = one(spark, quality.line_lengths(F.lit(said)))
        assert got == ([len(x) for x in said.splitlines()] or [0]), said


def test_units_fall_back_to_their_segment(spark):
    kind = "key long, idx long, start_ms long, end_ms long, text string, source_text string, words array<struct<text:string,start_ms:long,end_ms:long>>"
    rows = [
        (1, 0, 0, 900, " a b ", None, [("a", None, None), (" ", 1, 2), (" b", 400, None)]), (1, 1, 900, 950, "c", "d", [("c", 900, 950)]), (1, 2, 950, 960, " ", None, [(" ", 1, 2)]),
        (1, 3, 960, 990, "e f", "e f", None), (2, 0, 5, 6, "g", "g", [("g", 5, 6)]), (2, 1, 7, 8, "h i", None, [("", 7, 8)]),
    ]
    found = units.units(spark.createDataFrame(rows, kind))
    assert [tuple(r) for r in found.orderBy("key", "i").collect()] == [
        (1, 0, 0, 0, "a", 0, 0), (1, 1, 400, 400, "b", 0, 2), (1, 2, 900, 950, "c", 1, None), (1, 3, 960, 990, "e f", 3, None), (2, 0, 5, 6, "g", 0, 0), (2, 1, 7, 8, "h i", 1, None),
    ]
    blocks = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 3, 3), (2, 1, 0, 1)], "conv_id long, block long, first_i long, last_i long")
    assert {tuple(map(str, r)) for r in units.payload(blocks, found).collect()} == {("1", "1", "[0, 1]", "['0:0', '0:2']", "3"), ("1", "2", "[3]", "[]", "2"), ("2", "1", "[0, 1]", "['0:0']", "3")}


def test_segments_are_read_from_lists_and_objects(spark):
    rows = spark.createDataFrame([(1, '[{"start":1,"end":2.5,"text":"x","words":[{"text":"x","start":1}]},{"start":3}]'), (2, '{"segments":[{"start":0,"end":1}]}'), (3, "{}"), (4, "no"), (5, None), (6, "[]")], "key long, content string")
    found = units.decoded(rows)
    assert {(r.key, r.idx, r.start_ms, r.end_ms, r.text, r.valid) for r in found.collect()} == {(1, 0, 1000, 2500, "x", True), (1, 1, 3000, None, "", False), (2, 0, 0, 1000, "", True)}
    assert [tuple(r) for r in units.invalid(found).collect()] == [(1, 1)]


def test_replies_and_records_say_what_is_wrong(spark):
    rows = spark.createDataFrame([
        (1, '[{"index":0,"text":"a","status":"corrected"}]', 1), (2, "x", 1), (3, "[]", 1), (4, '[{"index":1,"text":"a"}]', 1), (5, '[{"index":0}]', 1), (6, '[{"index":0,"text":"a","status":"odd"}]', 1),
    ], "key long, reply string, expected int")
    assert {r.key: r.problem for r in content.parsed_replies(rows).collect()} == {1: None, 2: "not an array", 3: "count", 4: "index", 5: "text", 6: "status"}
    assert one(spark, content.diff_form(F.lit("json"), F.lit('{"b":[1,{}],"a":"é"}'))) == '{\n  "a": "é",\n  "b": [\n    1,\n    {}\n  ]\n}\n'
    assert one(spark, content.text_form(F.lit("bytes"), F.lit("x"))) is None


def test_small_read_models(spark):
    assert one(spark, models.progress_seconds(F.lit("out_time=0:01:2.5"))) == 62.5 and one(spark, models.progress_seconds(F.lit("out_time_us=x"))) is None
    assert one(spark, models.segment_progress(F.lit(5), F.lit(10), F.lit(0))) == 0.5 and one(spark, models.segment_progress(F.lit(5), F.lit(9), F.lit(9))) == 0.0
    assert one(spark, models.hotwords(F.array(F.lit(" a"), F.lit(" ")))) == "a" and one(spark, models.short_time(F.lit("x"))) == "x"
    assert one(spark, text.language_code(F.lit(" EN"), {"en": "eng"})) == "eng" and one(spark, timecode.time_ms(F.lit(None).cast("double"), F.lit(0.0005))) == 1
    assert one(spark, timecode.seconds_to_ms(F.lit(0.0025))) == 2 and one(spark, timecode.clock_seconds(F.lit("1:2"))) is None


def test_host_test_and_ordered_union(spark):
    urls = {"https://www.youtube.com/x": True, "https://youtu.be/1": True, "https://notyoutube.com": False, "junk": False, None: False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", catalog.is_host(F.col("u")).alias("x")).collect()
    assert {r.u: r.x for r in got} == urls


def test_streams_equal_the_batch_operators(spark, small, tmp_path):
    log = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("workflow_id"), (F.col("event_id") % 3).cast("int").alias("step"), "event_id", F.least("value", F.lit(100.0)).alias("percent"), F.col("event_type").alias("type"))
    for k in range(3):
        log.where(F.floor(F.col("event_id") / 400) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("numbered", tail.numbered(read()), "append"), ("throttled", tail.throttled(read(), 10.0), "append"), ("counts", tail.counts(read()), "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = events.appended(log.withColumn("ts", F.col("event_id"))).select("workflow_id", "event_id", "sequence")
    assert {tuple(r) for r in spark.table("numbered").collect()} == {tuple(r) for r in batch.collect()}
    batch = events.throttled(log.withColumn("sequence", F.col("event_id")), 10.0).select("workflow_id", "step", "sequence", "percent")
    assert {tuple(r) for r in spark.table("throttled").collect()} == {tuple(r) for r in batch.collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in log.groupBy("workflow_id", "type").count().collect()}


def test_chained_steps_know_their_references(spark):
    rows = spark.createDataFrame([(1, "a b")], "k long, text string")
    upper = lambda df, column: df.withColumn(column, F.upper(column))
    out = chained([Step("one", upper, {"df": "src"}, {"column": "text"}), Step("two", upper, {"df": "one"}, {"column": "text"})], {"src": rows})
    assert out["two"].first().text == "A B"
    for steps in ([Step("one", upper, {"df": "later"})], [Step("src", upper, {"df": "src"})]):
        with pytest.raises(ValueError):
            chained(steps, {"src": rows})


def greedy_lines(said, width, lines):
    out, line = [], ""
    for word in said.split():
        if not line or len(line) + 1 + len(word) <= width or len(out) + 1 >= lines:
            line = f"{line} {word}".strip()
        else:
            out.append(line)
            line = word
    return "\n".join([*out, line])


def test_wrapping_is_greedy_and_the_last_line_takes_the_rest(spark):
    pick = random.Random(5)
    said = [" ".join("x" * pick.choice([1, 2, 5, 9, 13, 30]) for _ in range(pick.randint(0, 14))) for _ in range(500)] + ["  a  b\n c ", "\U0001f600" * 12 + " a b c d e f g"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for width, lines in ((10, 1), (10, 2), (12, 3)):
        got = [r.x for r in rows.select(text.wrapped(F.col("t"), width, lines).alias("x")).collect()]
        whole = [" ".join(t.split()) for t in said]
        assert got == [w if len(w) <= width else greedy_lines(w, width, lines) for w in whole]


def test_conversations_of_one_partition_are_numbered_apart_and_lone_short_blocks_stay(spark):
    rows = [(c, i, 100 * i, 100 * i + 90, w) for c, said in ((1, "ab"), (2, "cd"), (3, "e")) for i, w in enumerate(said)]
    words = spark.createDataFrame(rows, "conv_id long, i long, start_ms long, end_ms long, word string").coalesce(1)
    for name in ("default", "readable"):
        got = segmentation.blocks(words, segmentation.PROFILES[name]).orderBy("conv_id").collect()
        assert [(r.conv_id, r.block, r.first_i, r.last_i, r.text) for r in got] == [(1, 1, 0, 1, "a b"), (2, 1, 0, 1, "c d"), (3, 1, 0, 0, "e")]
    assert segmentation.blocks(words.limit(0)).count() == 0
