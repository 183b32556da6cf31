"""WAV files as rows of samples, and byte ranges.

Reading: a share of the frames of one file is read by one task, from the chunk headers and its own bytes, so files of any size are read and no task holds one whole.  Files are listed by tasks,
and shares are dealt to as many tasks as their bytes call for, but small ones to no more than keep all cores busy.
A row holds up to FRAMES_PER_ROW frames: ``path, rate, channels, frames, first_frame, samples, reason``.  A file that is not 16-bit PCM, or is cut or malformed, is one row with a ``reason``
and no samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.sources.files import BATCH_BYTES
from cueframe.sources.store import dealt, listing, opened

WAV_COLUMNS = "path string, rate int, channels int, frames long, first_frame long, samples array<short>, reason string"
_SCHEMA = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("first_frame", pa.int64()), ("samples", pa.list_(pa.int16())), ("reason", pa.string())])
FRAMES_PER_ROW = 65_536
#: Bytes of a share of a file.
TASK_BYTES = 64 << 20
#: Chunks of a file; more are no recording.
MOST_CHUNKS = 10_000


@dataclass
class Form:
    """Where a file's frames are: ``width`` bytes each, of which the first ``2 * channels`` hold the samples."""

    rate: int
    channels: int
    width: int
    at: int
    frames: int


def wav_form(file: pa.NativeFile, size: int) -> Form:
    """The form of a 16-bit PCM file, from its chunk headers; ValueError with the reason if it is none."""
    if size < 44:
        raise ValueError("shorter than a header")
    head = file.read_at(12, 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    number = lambda raw: int.from_bytes(raw, "little")
    at, form, data, chunks = 12, None, None, 0
    while at + 8 <= size:
        chunk = file.read_at(8, at)
        length, start = number(chunk[4:]), at + 8
        if start + length > size:
            raise ValueError("a chunk goes beyond the end")
        if chunk[:4] == b"fmt ":
            if length < 16:
                raise ValueError("short format")
            form = file.read_at(16, start)
        elif chunk[:4] == b"data":
            data = start, length
        at, chunks = start + length + length % 2, chunks + 1
        if chunks > MOST_CHUNKS:
            raise ValueError("too many chunks")
    if form is None or data is None or not data[1]:
        raise ValueError("no format or no samples")
    kind, channels, rate, width, bits = number(form[:2]), number(form[2:4]), number(form[4:8]), number(form[12:14]), number(form[14:16])
    if kind != 1 or bits != 16 or not channels:
        raise ValueError("not 16-bit PCM")
    if width < 2 * channels:
        raise ValueError("frames overlap")
    if data[1] < width:
        raise ValueError("no format or no samples")
    return Form(min(rate, 2**31 - 1), channels, width, data[0], data[1] // width)


def frames_of(file: pa.NativeFile, form: Form, first: int, past: int) -> np.ndarray:
    """The samples of frames ``first`` to ``past``, channels side by side."""
    raw = np.frombuffer(file.read_at((past - first) * form.width, form.at + first * form.width), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, form.width)[:, : 2 * form.channels]).view("<i2").ravel()


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A 16-bit PCM file of interleaved samples."""
    body = np.asarray(samples, "<i2").tobytes()
    number = lambda x, n: int(x).to_bytes(n, "little")
    form = number(1, 2) + number(channels, 2) + number(rate, 4) + number(2 * channels * rate, 4) + number(2 * channels, 2) + number(16, 2)
    return b"RIFF" + number(36 + len(body), 4) + b"WAVEfmt " + number(16, 4) + form + b"data" + number(len(body), 4) + body


def _share(files: fs.FileSystem, name: str, path: str, size: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    with files.open_input_file(path) as file:
        try:
            form = wav_form(file, size)
        except ValueError as wrong:
            if not part:
                yield _row(name, None, None, None, None, None, str(wrong))
            return
        first, past = form.frames * part // parts, form.frames * (part + 1) // parts
        for a in range(first, past, FRAMES_PER_ROW):
            yield _row(name, form.rate, form.channels, form.frames, a, frames_of(file, form, a, min(past, a + FRAMES_PER_ROW)), None)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA, strict=True)], schema=_SCHEMA)


def read_wav(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The 16-bit PCM files below ``path`` as rows of samples; a share of a file has at most ``task_bytes``."""

    def shares(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        for batch in found:
            rows, held = [], 0
            for name, place, whole, part, parts, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for row in _share(files, name, place, whole, part, parts):
                    rows.append(row)
                    held += row.nbytes
                    if held >= BATCH_BYTES:
                        yield pa.concat_batches(rows)
                        rows, held = [], 0
            if rows:
                yield pa.concat_batches(rows)

    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / task_bytes)).cast("int")
    rows = listing(spark, path).select("name", "path", F.col("size").alias("whole"), parts.alias("parts"))
    rows = rows.select("name", "path", "whole", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    return dealt(rows.withColumn("size", F.floor(F.col("whole") / F.col("parts"))), task_bytes).mapInArrow(shares, WAV_COLUMNS)


def byte_range(content: Column, header: str) -> Column:
    """The bytes of an HTTP range ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n``; null for a range that cannot be met."""
    spec = header.removeprefix("bytes=").strip()
    first, _, last = spec.partition("-")
    size = F.length(content)
    if not first:
        n = F.least(F.lit(int(last)), size)
        return F.when(size > 0, F.substring(content, size - n + 1, n))
    start = int(first)
    end = F.least(F.lit(int(last)), size - 1) if last else size - 1
    return F.when((size > start) & (end >= start), F.substring(content, F.lit(start + 1), end - start + 1))
