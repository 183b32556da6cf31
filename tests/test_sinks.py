"""Sinks: written, read back and equal; a job that fails leaves nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cueframe.operators import content, sinks
from cueframe.sources import files as sources
from cueframe.sources.files import read_files, write_files
from cueframe.sources.store import checked, shared_folder


def files(spark, *rows):
    return spark.createDataFrame(rows, "name string, content string")


def tree(path):
    return sorted(os.path.relpath(os.path.join(a, f), path) for a, _, names in os.walk(path) for f in names)


def back(spark, path):
    return {r.name: bytes(r.content).decode() for r in read_files(spark, path).collect()}


def test_rows_of_a_name_are_one_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = files(spark, ("a.txt", "1\n"), ("a.txt", "2\n"), ("b/c.txt", None), ("b/d.txt", "é")).coalesce(1)
    write_files(rows, path)
    assert back(spark, path) == {"a.txt": "1\n2\n", "b/c.txt": "", "b/d.txt": "é"}
    assert tree(path) == ["a.txt", "b/c.txt", "b/d.txt"]
    write_files(files(spark, ("a.txt", "new")), path)
    assert back(spark, path)["a.txt"] == "new" and len(tree(path)) == 3
    write_files(files(spark, ("x.txt", "only")), path, "overwrite")
    assert back(spark, path) == {"x.txt": "only"}
    assert {r.size for r in read_files(spark, path).collect()} == {4}


def test_no_rows_and_no_folder(spark, tmp_path):
    write_files(files(spark, ("a", "b")).where("false"), str(tmp_path / "none"))
    assert read_files(spark, str(tmp_path / "none")).count() == read_files(spark, str(tmp_path / "never")).count() == 0


@pytest.mark.parametrize("bad", [None, "", "/abs", "../up", "a/../b", "_hidden", ".x", "a//b"])
def test_names_stay_below_the_folder(bad):
    with pytest.raises(ValueError):
        checked(bad)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_files(files(spark, ("kept.txt", "old")), path)
    many = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").alias("content"))
    for bad in (
        many.unionByName(files(spark, ("../up", "x"))),  # one task fails after others have written
        many.select("name", F.expr("IF(name = 'f39', raise_error('no'), content)").alias("content")),
        many.unionByName(files(spark, ("f7", "again"))),  # two tasks write one name
        files(spark, ("a", "1"), ("b", "2"), ("a", "3")).coalesce(1),  # rows of a name are apart
    ):
        with pytest.raises(Exception, match=r"."):
            write_files(bad, path, "overwrite")
        assert tree(path) == ["kept.txt"]
    assert os.listdir(path) == ["kept.txt"]


def test_the_driver_handles_attempts_and_no_names(spark, tmp_path, monkeypatch):
    """The commit's note has a line for each attempt, and files in folders of several levels are listed by tasks."""
    path, notes, placed = str(tmp_path / "out"), [], sources._placed

    def spied(spark, path, staging, overwrite):
        with open(f"{staging}/{sources.COUNTED}") as note:
            notes.append(note.read())
        placed(spark, path, staging, overwrite)

    monkeypatch.setattr(sources, "_placed", spied)
    rows = spark.range(0, 500, 1, 2).select(F.expr("concat(id % 5, '/', id % 100, '/f', id)").alias("name"), F.col("id").cast("string").alias("content"))
    write_files(rows, path)
    assert notes[0].count("_staging-") == 2 and "f17" not in notes[0]
    assert back(spark, path) == {f"{k % 5}/{k % 100}/f{k}": str(k) for k in range(500)} and len(tree(path)) == 500
    write_files(rows.where("id < 3"), path, "overwrite")
    assert tree(path) == ["0/0/f0", "1/1/f1", "2/2/f2"]


def test_subtitle_file(spark, tmp_path):
    rows = [(1, 1, 0, 1250, "Hello"), (1, 2, 1250, 3_600_000, "two\nlines"), (2, 1, 5, 10, None)]
    frame = spark.createDataFrame(rows, "conv_id long, block long, start_ms long, end_ms long, text string").coalesce(1)
    write_files(sinks.srt_files(frame), str(tmp_path / "srt"))
    assert back(spark, str(tmp_path / "srt"))["1.srt"] == "1\n00:00:00,000 --> 00:00:01,250\nHello\n\n2\n00:00:01,250 --> 01:00:00,000\ntwo\nlines\n"


def test_exports_refuse_files(spark, tmp_path):
    rows = [(1, "text", "a\n"), (2, "json", '{"b": [1, {"z": null, "a": "é"}], "a": {}}'), (3, "bytes", "\x00\x01"), (4, "file", "/v.mp4"), (5, None, "x")]
    versions = spark.createDataFrame(rows, "version_id long, encoding string, raw string").withColumn("raw", F.encode("raw", "UTF-8"))
    write_files(sinks.export_files(versions, F.concat(F.lit("v"), "version_id")), str(tmp_path / "x"))
    assert back(spark, str(tmp_path / "x")) == {"v1": "a\n", "v2": '{\n  "a": {},\n  "b": [\n    1,\n    {\n      "a": "é",\n      "z": null\n    }\n  ]\n}', "v3": "\x00\x01"}
    assert {r.version_id for r in sinks.export_refused(versions).collect()} == {4, 5}


def test_event_lines_have_no_blanks_at_the_end(spark, tmp_path):
    log = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "said"), (2, 1, "c", "")], "workflow_id long, sequence long, type string, message string").repartition(3)
    write_files(sinks.event_files(log, F.col("message")), str(tmp_path / "x"))
    assert back(spark, str(tmp_path / "x")) == {"1.log": "1 a said\n2 b\n", "2.log": "1 c\n"}


def test_cached_files_come_with_their_metadata(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "video"), ("k2", "")], "key string, content string")
    write_files(sinks.cache_files(rows, F.create_map(F.lit("title"), F.lit("t"))), str(tmp_path / "c"))
    stored, entries = sinks.cached(read_files(spark, str(tmp_path / "c")))
    assert all(r.hit for r in content.cache_hits(rows.select("key"), stored, entries).collect())
    (tmp_path / "c" / "k1" / "content").write_text("other")
    assert {r.key: r.hit for r in content.cache_hits(rows.select("key"), stored, entries).collect()} == {"k1": False, "k2": True}
    assert '"source_metadata":{"title":"t"}' in (tmp_path / "c" / "k1" / "metadata.json").read_text()


def test_shared_folder_is_below_the_checkpoint_folder(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
