"""Maps through a model that answers in chunks: translation and correction, with calls in flight, a checkpoint for each finished chunk, halving, and rounds for what is missing.

The client is injected: it takes a user message and returns the reply.  A task keeps ``window`` calls in flight, and ``tasks`` partitions bound the calls of the whole cluster.  A chunk's
result is written by the task itself as soon as it is there, under the fingerprint of its key's texts and of the request's settings, and their total; so a job that is stopped, or some of whose chunks fail,
asks only for the rest when it is run again, and results of other texts or settings are not taken up.

Defined cases: null texts are empty; a key's rows are numbered by ``idx``, which must be unique in it; files that are cut, of another form, or name no row are passed over; a chunk
that stands twice counts once; no rows give none.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import batched
from typing import Any, Protocol, TypeVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.functions.hashing import content_hash
from cueframe.operators.segmentation import chunks
from cueframe.sources.store import opened

Client = Callable[[str], str]
Row = dict[str, Any]
A, B = TypeVar("A"), TypeVar("B")

STATUSES = ("unchanged", "corrected", "uncertain")
DONE = "key long, fingerprint string, total long, idx long, text string, status string, reason string"
#: Results of chunks that a task tells of at once.
RESULTS = 1000
_COLUMNS = [c.split()[0] for c in DONE.split(", ")]


def in_order(jobs: Iterable[A], work: Callable[[A], B], window: int) -> Iterator[B]:
    """``work`` of each job, in order, with at most ``window`` at a time; the first error is raised, what has not begun is cancelled."""
    running: deque[Future] = deque()
    pool = ThreadPoolExecutor(window)
    try:
        for job in jobs:
            if len(running) == window:
                yield running.popleft().result()
            running.append(pool.submit(work, job))
        while running:
            yield running.popleft().result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def message(payload: dict) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def indexed(reply: str, n: int) -> list[dict]:
    """The items of a reply; ValueError unless it is an array of ``n`` objects with their index in order and a text each."""
    items = json.loads(reply)
    if not isinstance(items, list):
        raise ValueError("the reply is no array")
    if len(items) != n:
        raise ValueError(f"{n} items wanted, {len(items)} came")
    for k, item in enumerate(items):
        if not isinstance(item, dict) or item.get("index") != k or isinstance(item.get("index"), bool) or not isinstance(item.get("text"), str):
            raise ValueError(f"item {k} is wrong")
    return items


class Request(Protocol):
    """What is asked of a chunk, and what its reply means: ``text``, ``status`` and ``reason`` of each row."""

    def settings(self) -> dict: ...
    def ask(self, rows: list[Row]) -> str: ...
    def read(self, reply: str, rows: list[Row]) -> list[tuple[str, str | None, str | None]]: ...


@dataclass(frozen=True)
class Translation:
    source_lang: str
    target_lang: str
    model: str = "model"
    rules: tuple[dict, ...] = field(default=())

    def settings(self) -> dict:
        return {"kind": "translation", "model": self.model, "source_lang": self.source_lang, "target_lang": self.target_lang, "glossary_rules": list(self.rules)}

    def ask(self, rows: list[Row]) -> str:
        payload: dict[str, Any] = {"source_lang": self.source_lang, "target_lang": self.target_lang, "segments": [{"index": k, **_timed(r)} for k, r in enumerate(rows)]}
        if self.rules:
            payload["glossary_rules"] = list(self.rules)
        return message(payload)

    def read(self, reply: str, rows: list[Row]) -> list[tuple[str, str | None, str | None]]:
        return [(item["text"], None, None) for item in indexed(reply, len(rows))]


@dataclass(frozen=True)
class Correction:
    source_lang: str
    model: str = "model"
    domain_context: str | None = None
    rules: tuple[dict, ...] = field(default=())
    threshold: float | None = None

    def settings(self) -> dict:
        return {"kind": "correction", "model": self.model, "source_lang": self.source_lang, "domain_context": self.domain_context, "glossary_rules": list(self.rules), "threshold": self.threshold}

    def ask(self, rows: list[Row]) -> str:
        payload: dict[str, Any] = {"source_lang": self.source_lang, "segments": [self._segment(k, r) for k, r in enumerate(rows)]}
        if self.domain_context is not None:
            payload["domain_context"] = self.domain_context
        if self.rules:
            payload["glossary_rules"] = list(self.rules)
        return message(payload)

    def _segment(self, k: int, row: Row) -> dict:
        out = {"index": k, **_timed(row)}
        confidence = row.get("confidence")
        if confidence is not None:
            out["confidence"] = confidence
        words = [{f: w[f] for f in ("text", "start", "end", "confidence") if w.get(f) is not None or f == "text"} for w in row.get("words") or ()]
        if words:
            out["words"] = words
        if self.threshold is not None:
            if low := [w for w in words if w.get("confidence", self.threshold) < self.threshold]:
                out["low_confidence_words"] = low
            if confidence is not None:
                out["below_uncertainty_threshold"] = confidence < self.threshold
        return out

    def read(self, reply: str, rows: list[Row]) -> list[tuple[str, str | None, str | None]]:
        out = []
        for item, row in zip(indexed(reply, len(rows)), rows, strict=True):
            status, reason = item.get("status"), item.get("uncertain_reason")
            if status is not None and status not in STATUSES:
                raise ValueError("a status is wrong")
            if reason is not None and not isinstance(reason, str):
                raise ValueError("a reason is no text")
            out.append((item["text"], status or ("unchanged" if item["text"] == row["text"] else "corrected"), reason))
        return out


def _timed(row: Row) -> dict:
    return {f: row[f] for f in ("start", "end", "text") if row.get(f) is not None}


def asked(client: Client, request: Request, rows: list[Row]) -> list[tuple[str, str | None, str | None]]:
    """The results of a chunk; one whose reply is wrong is halved, and a single row's error is raised."""
    try:
        return request.read(client(request.ask(rows)), rows)
    except ValueError:
        if len(rows) == 1:
            raise
    half = (len(rows) + 1) // 2
    return asked(client, request, rows[:half]) + asked(client, request, rows[half:])


def marks(segments: DataFrame, request: Request) -> DataFrame:
    """``key, fingerprint, total``: of the settings, and of every row's place, content and text."""
    extra = [c for c in ("start", "end", "confidence", "words") if c in segments.columns]
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), *extra))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", content_hash(said).alias("h")))), lambda x: F.concat_ws(":", x["idx"].cast("string"), x["h"])), ",")
    return segments.groupBy("key").agg(content_hash(F.concat_ws("|", F.lit(message(request.settings())), listed)).alias("fingerprint"), F.count(F.lit(1)).alias("total"))


def completed(segments: DataFrame, path: str, known: DataFrame) -> DataFrame:
    """``DONE`` rows of the checkpoint that fit ``marks``: same fingerprint and total, a row that is there, a text; each row once."""
    spark = segments.sparkSession
    files, root = opened(f"{path}/chunks")
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return spark.createDataFrame([], DONE)
    rows = spark.read.schema(DONE).option("recursiveFileLookup", "true").json(f"{path}/chunks").where(F.col("text").isNotNull())
    rows = rows.join(known, ["key", "fingerprint", "total"], "left_semi").join(segments.select("key", "idx"), ["key", "idx"], "left_semi")
    return rows.groupBy("key", "idx").agg(F.min(F.struct(*[c for c in _COLUMNS if c not in ("key", "idx")])).alias("x")).select("key", "x.fingerprint", "x.total", "idx", "x.text", "x.status", "x.reason")


class _Log:
    """The results of one task attempt, a line for each row.  A chunk's lines are written and flushed together as soon as it is done; a line that is cut is passed over by readers."""

    def __init__(self, place: str) -> None:
        self.place, self.stream, self.lock = place, None, threading.Lock()

    def write(self, lines: list[str]) -> None:
        with self.lock, contextlib.suppress(OSError):  # what is not written is asked for again
            if self.stream is None:
                files, root = opened(self.place)
                files.create_dir(root, recursive=True)
                self.stream = files.open_output_stream(f"{root}/{uuid.uuid4().hex}.jsonl", buffer_size=0)
            self.stream.write(("\n".join(lines) + "\n").encode())
            self.stream.flush()

    def close(self) -> None:
        with contextlib.suppress(OSError):
            if self.stream is not None:
                self.stream.close()


def _chunk_writer(client: Client, request: Request, path: str, window: int):
    """Chunks ``key, fingerprint, total, rows`` -> each one's error or null, once its results are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = _Log(f"{path}/chunks")

        def one(chunk: tuple) -> tuple[int, str | None]:
            key, fingerprint, total, rows = chunk
            try:
                got = asked(client, request, rows)
            except Exception as wrong:  # a chunk that fails leaves the others alone
                return key, f"{type(wrong).__name__}: {wrong}"
            log.write([json.dumps(dict(zip(_COLUMNS, (key, fingerprint, total, r["idx"], *x), strict=True)), ensure_ascii=False) for r, x in zip(rows, got, strict=True)])
            return key, None

        todo = (x for batch in batches for x in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        try:
            for results in batched(in_order(todo, one, window), RESULTS):
                keys, errors = zip(*results, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(errors, pa.string())], ["key", "error"])
        finally:
            log.close()

    return run


def mapped(segments: DataFrame, request: Request, client: Client, path: str, size: int = 20, window: int = 4, tasks: int | None = None, rounds: int = 2) -> DataFrame:
    """``key, idx, source_text, text, status, reason`` of ``segments`` (``key, idx, text``; ``start, end, confidence, words`` if there are).

    Asks for the chunks that the checkpoint below ``path`` lacks, then up to ``rounds`` times for each missing row alone, and raises an error with the first missing row if some still are.
    Chunks are counted over all rows of a key, so a run that goes on asks for the same ones.
    """
    known = marks(segments, request)
    fields = [c for c in ("idx", "text", "start", "end", "confidence", "words") if c in segments.columns]
    rows = segments.withColumn("text", F.coalesce("text", F.lit("")))
    error = None
    for turn in range(rounds + 1):
        missing = chunks(rows, size if turn == 0 else 1, "key", "idx").join(completed(segments, path, known).select("key", "idx"), ["key", "idx"], "left_anti")
        todo = missing.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")).join(known, "key").select("key", "fingerprint", "total", "rows")
        todo = todo.repartition(tasks) if tasks else todo
        asked_for, error = todo.mapInArrow(_chunk_writer(client, request, path, window), "key long, error string").agg(F.count(F.lit(1)), F.max("error")).first()
        if not asked_for:
            break
    done = completed(segments, path, known)
    lost = segments.select("key", "idx").join(done.select("key", "idx"), ["key", "idx"], "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "idx")).alias("first")).first()
    if lost.n:
        last = f" Last error: {error}." if error else ""
        raise ValueError(f"{lost.n} rows have no result after {rounds} rounds. The first is {lost.first.key}/{lost.first.idx}.{last} Run again to go on from the checkpoint.")
    return rows.select("key", "idx", F.col("text").alias("source_text")).join(done.select("key", "idx", "text", "status", "reason"), ["key", "idx"])


class Answering:
    """A client for tests and queries: each text with a tag before it, as a model that answers any chunk would give it."""

    def __init__(self, tag: str) -> None:
        self.tag = tag

    def __call__(self, asked: str) -> str:
        return json.dumps([{"index": s["index"], "text": f"[{self.tag}] {s['text']}" if s["index"] % 2 == 0 else s["text"]} for s in json.loads(asked)["segments"]])
