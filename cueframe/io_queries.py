"""Queries of the sinks, media files, live logs and resumable maps: each writes into the shared folder, reads back, and returns what was read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cueframe.operators import content, events, model_map, review, segmentation, sinks
from cueframe.queries import Query, _files_of, _keyed, _log, _words, _workflows
from cueframe.sources.files import read_files, write_files
from cueframe.sources.media import byte_range, read_wav, wav_bytes
from cueframe.sources.store import shared_folder
from cueframe.sources.tables import table
from cueframe.streaming import event_log, monitor

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Sinks


@query
def srt_written(spark, d):
    path = shared_folder(spark, "srt")
    write_files(sinks.srt_files(segmentation.materialized(segmentation.blocks(_words(spark, d)))), path)
    return read_files(spark, path).select(F.substring_index("name", ".", 1).cast("long").alias("conv_id"), F.col("content").cast("string").alias("srt"), "size")


def _stored_versions(spark, d):
    """Customers as stored versions: text, JSON, bytes, and files, which are only named."""
    encoding = F.element_at(F.array(*[F.lit(x) for x in ("text", "json", "bytes", "file")]), (F.col("c_custkey") % 4).cast("int") + 1)
    said = F.when(F.col("c_custkey") % 4 == 1, F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key")))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("version_id"), encoding.alias("encoding"), F.encode(said, "UTF-8").alias("raw"))


@query
def versions_exported(spark, d):
    path, versions = shared_folder(spark, "exports"), _stored_versions(spark, d)
    name = F.concat(F.lit("versions/"), F.col("version_id").cast("string"), F.when(F.col("encoding") == "json", ".json").when(F.col("encoding") == "text", ".txt").otherwise(".bin"))
    write_files(sinks.export_files(versions, name), path)
    back = read_files(spark, path).select(F.regexp_extract("name", r"(\d+)\.", 1).cast("long").alias("version_id"), "name", F.col("size").alias("bytes_written"), F.col("content").cast("string").alias("content"))
    refused = sinks.export_refused(versions)
    return versions.select("version_id").join(back, "version_id", "left").join(refused, "version_id", "left")


@query
def event_lines(spark, d):
    path = shared_folder(spark, "events")
    message = F.when(F.col("step").isNotNull(), F.concat(F.lit("step "), F.col("step").cast("string")))
    write_files(sinks.event_files(_log(spark, d), message), path)
    return read_files(spark, path).select(F.substring_index("name", ".", 1).cast("long").alias("workflow_id"), F.col("content").cast("string").alias("lines"))


@query
def cache_written(spark, d):
    path, files = shared_folder(spark, "cache"), _files_of(spark, d)
    write_files(sinks.cache_files(files, F.create_map(F.lit("url"), F.concat(F.lit("doc:"), F.col("key").cast("string")))), path)
    stored, entries = sinks.cached(read_files(spark, path))
    hits = content.cache_hits(files.select(F.col("key").cast("string").alias("key")), stored, entries)
    return hits.join(entries, "key").select(F.col("key").cast("long").alias("key"), "hit", "content_size", "content_hash")


# Media files

RATE, FRAMES_PER_WORD = 1000, 20


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A recording of each conversation: FRAMES_PER_WORD frames a word, each seventh silent; some files are no WAVE, some have other samples than 16 bits."""
    for batch in batches:
        names, contents = [], []
        for conv, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            w = np.arange(words)
            loud = np.where(w % 7 == 0, 0, (conv * 37 + w * 101) % 199 * 150)
            samples = np.repeat(loud, FRAMES_PER_WORD) * np.tile([1, -1], words * FRAMES_PER_WORD // 2)
            raw = wav_bytes(samples, RATE)
            names.append(f"{conv}.wav")
            contents.append(raw.replace(b"WAVE", b"WAVX", 1) if conv % 10 == 3 else raw[:34] + b"\x08" + raw[35:] if conv % 10 == 4 else raw)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])


def _recordings(spark, d):
    path = shared_folder(spark, "recordings")
    words = _words(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("words"))
    write_files(words.mapInArrow(_recorded, "name string, content binary"), path)
    # Small shares, so that recordings of the tests' size are read by several tasks each.
    return read_wav(spark, path, 8192)


@query
def waveform_by_file(spark, d):
    return review.file_levels(_recordings(spark, d)).select(F.substring_index("path", ".", 1).cast("long").alias("conv_id"), "bar", "level")


@query
def recordings_read(spark, d):
    rows = _recordings(spark, d)
    read = F.sum(F.size("samples"))
    return rows.groupBy(F.substring_index("path", ".", 1).cast("long").alias("conv_id")).agg(F.max("rate").alias("rate"), F.max("channels").alias("channels"), F.max("frames").alias("frames"), F.max("reason").alias("reason"), F.when(F.max("frames").isNotNull(), read).alias("samples"))


@query
def byte_ranges(spark, d):
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ranges = {"head": "bytes=0-9", "middle": "bytes=100-119", "rest": "bytes=2000-", "tail": "bytes=-7"}
    return table(spark, d, "documents").select("doc_id", *[F.hex(byte_range(raw, spec)).alias(name) for name, spec in ranges.items()])


# Live logs: written in two appends; the stream is stopped after the first and goes on from its offsets


def _tailed(spark, d, name, start, wait=True):
    path, log = shared_folder(spark, name), _log(spark, d)
    for part in (log.where("sequence <= 40"), log.where("sequence > 40")):
        event_log.append_log(part, f"{path}/log", 25)
        start(event_log.tail(spark, f"{path}/log", wait=wait), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


@query
def events_tailed(spark, d):
    out = _tailed(spark, d, "tail", event_log.write_sse)
    event = F.explode(F.filter(F.split(F.col("content").cast("string"), "\n\n"), lambda e: e != ""))
    rows = read_files(spark, out).select(F.regexp_extract("name", r"(\d+)\.sse$", 1).cast("long").alias("workflow_id"), event.alias("text"))
    return rows.select("workflow_id", F.regexp_extract("text", r"^id: (\d+)", 1).cast("long").alias("sequence"), F.concat("text", F.lit("\n\n")).alias("text"))


def _monitored(spark, d, name):
    def start(stream, out, checkpoint):
        rows = monitor.monitored(stream, completed="purchase", failed="error", started="view", progress="click", delta=10.0)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    before = spark.conf.get(monitor.STATE_STORE)
    spark.conf.set(monitor.STATE_STORE, monitor.ROCKS_DB)
    try:
        # The monitor's own state keeps events that come early.
        out = _tailed(spark, d, name, start, wait=False)
    finally:
        spark.conf.set(monitor.STATE_STORE, before)
    return monitor.final(spark.read.schema(monitor.OUTPUT).parquet(out))


@query
def monitor_streamed(spark, d):
    return events.statuses(_monitored(spark, d, "monitor")[0], _workflows(spark, d), 6)


@query
def progress_streamed(spark, d):
    return _monitored(spark, d, "progress")[2]


# Maps through a model: the first client fails in some chunks, so the second run finds the rest in the checkpoint


class _Failing(model_map.Answering):
    """Fails for chunks in which a text has a word of three letters that begins with "o"."""

    def __call__(self, asked):
        if any(w[:1] == "o" and len(w) == 3 for s in json.loads(asked)["segments"] for w in s["text"].split()):
            raise RuntimeError("no answer")
        return super().__call__(asked)


def _resumed(spark, d, request, name):
    path, rows = shared_folder(spark, name), _keyed(spark, d)
    try:
        return model_map.mapped(rows, request, _Failing("zh"), path, 3, rounds=0)
    except ValueError:
        return model_map.mapped(rows, request, model_map.Answering("zh"), path, 3)


@query
def translation_resumed(spark, d):
    return _resumed(spark, d, model_map.Translation("en", "zh"), "translation").select("key", "idx", "source_text", "text")


@query
def correction_resumed(spark, d):
    return _resumed(spark, d, model_map.Correction("en", threshold=0.5), "correction").select("key", "idx", "text", "status", "reason")
