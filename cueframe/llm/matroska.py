"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues as packet tables.

``mux`` writes one audio track of 8-bit PCM; ``packets`` reads any Matroska file's blocks (SimpleBlocks and BlockGroups, with no, Xiph,
EBML or fixed lacing, known or unknown sizes) as rows of track, timestamp and byte range.

Frames of one lace follow each other by the track's default duration or, for PCM without one, by their samples.  A block of a group is a key frame unless the group refers
to another.  Bytes that header stripping took off a track's frames are given beside its byte ranges; other content encodings are not undone.

Defined cases of the query: a null or empty text has the payload of 64 zero bytes; equal texts give equal values; an empty
table gives an empty table; other columns are ignored.  ``packet_table``: a null or unreadable file gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import release, utf8

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUX_APP, WRITE_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
RATE, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE, DEFAULT_DURATION = 0xFB, 0x23E383
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
HEADER_STRIPPING = 3
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SAMPLE_RATE, FRAME, LACED, CLUSTER_FRAMES = 8000, 512, 8, 128
_MASTERS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_PLACE, INFO, ENCODINGS, ENCODING, COMPRESSION}


def vint(value: int) -> bytes:
    """A size in the shortest form; all ones are kept for 'unknown'."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(ident: int, value: float) -> bytes:
    return element(ident, np.array([value], ">f8").tobytes())


_HEADER = element(EBML, b"".join([uint(VERSION, 1), uint(READ_VERSION, 1), uint(MAX_ID, 4), uint(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ, 2)]))
_TRACKS = element(TRACKS, element(TRACK, b"".join([
    uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(LACING, 1), uint(DEFAULT_DURATION, 1_000_000_000 * FRAME // SAMPLE_RATE), element(CODEC, b"A_PCM/INT/LIT"),
    element(AUDIO, _float(RATE, SAMPLE_RATE) + uint(CHANNELS, 1) + uint(DEPTH, 8)),
])))


def _block(track: int, ticks: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock; several frames are laced: fixed if of one size, else by EBML differences."""
    head = vint(track) + ticks.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(x) for x in frames]
    if len(set(sizes)) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    coded = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = 1
        while abs(b - a) >= (1 << 7 * n - 1) - 1:
            n += 1
        coded.append((b - a + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big"))
    return head + b"\x86" + bytes([len(frames) - 1]) + b"".join(coded) + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """One mono track of 8-bit samples: frames of FRAME samples, LACED to a block, a cue for each cluster.  A tick is a sample."""
    info = element(INFO, uint(SCALE, 1_000_000_000 // SAMPLE_RATE) + _float(DURATION, len(samples)) + element(MUX_APP, b"cueframe") + element(WRITE_APP, b"cueframe"))
    parts, cues, at, span = [info, _TRACKS], [], len(info) + len(_TRACKS), FRAME * CLUSTER_FRAMES // 2
    for start in range(0, len(samples), span):
        body = [uint(TIMESTAMP, start)]
        past = min(start + span, len(samples))
        for first in range(start, past, FRAME * LACED):
            frames = [samples[k : min(k + FRAME, past)] for k in range(first, min(first + FRAME * LACED, past), FRAME)]
            body.append(element(SIMPLE_BLOCK, _block(1, first - start, frames)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, uint(CUE_TIME, start) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


class Malformed(ValueError):
    pass


@dataclass
class Media:
    """What one file holds; ``packets``: (track, cluster, time in ns, key frame, byte offset, length)."""

    packets: list[tuple[int, int, int, bool, int, int]] = field(default_factory=list)
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    segment: int = 0


def _ident(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    if n > 4:
        raise Malformed(f"no element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _size(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number, -1 for the unknown size, and the place after it."""
    n = 9 - data[at].bit_length()
    if n > 8:
        raise Malformed(f"no size at {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def _frames(data: bytes, at: int, past: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, past - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (past - at) % n:
            raise Malformed("fixed lacing of unequal frames")
        sizes = [(past - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                width = 9 - data[at].bit_length()
                size, at = _size(data, at)
                if k:
                    size = sizes[-1] + size - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(past - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced frames pass their block")
    ends = np.cumsum([at, *sizes]).tolist()
    return list(zip(ends, sizes, strict=False))


def demux(data: bytes) -> Media:
    """Walks the elements of a file."""
    out, end = Media(), len(data)
    track: dict[str, object] = {}
    cue = [0, 0, 0]
    base = group = 0
    referring: set[int] = set()
    blocks: list[tuple[int, int, int, bool, int, list[tuple[int, int]]]] = []
    stack = [(0, end, 0)]
    while stack:
        at, past, parent = stack.pop()
        while at < past:
            start = at
            ident, at = _ident(data, at)
            size, at = _size(data, at)
            if size < 0:
                if ident not in (SEGMENT, CLUSTER):
                    raise Malformed("unknown size of an element that must have one")
                size = past - at if ident == SEGMENT else _unknown_cluster(data, at, past) - at
            stop = at + size
            if stop > past:
                raise Malformed("an element passes its parent")
            if ident == SEGMENT:
                out.segment = at
            elif ident == CLUSTER:
                out.clusters.append(start)
            elif ident in (SIMPLE_BLOCK, BLOCK):
                number, k = _size(data, at)
                ticks, flags = int.from_bytes(data[k : k + 2], "big", signed=True), data[k + 2]
                key = bool(flags & 0x80) if ident == SIMPLE_BLOCK else True
                blocks.append((number, len(out.clusters) - 1, base + ticks, key, group if ident == BLOCK else 0, _frames(data, k + 3, stop, flags >> 1 & 3)))
            elif ident == BLOCK_GROUP:
                group += 1
            elif ident == REFERENCE:
                referring.add(group)
            elif ident == TIMESTAMP:
                base = int.from_bytes(data[at:stop], "big")
            elif ident == SCALE:
                out.scale = int.from_bytes(data[at:stop], "big")
            elif ident == TRACK:
                track = {}
            elif ident == TRACK_NUMBER:
                out.tracks[int.from_bytes(data[at:stop], "big")] = track
            elif ident in _TRACK_NUMBERS:
                track[_TRACK_NUMBERS[ident]] = int.from_bytes(data[at:stop], "big")
            elif ident == RATE:
                if size not in (0, 4, 8):
                    raise Malformed("a number of no known width")
                track["rate"] = float(np.frombuffer(data[at:stop], f">f{size}")[0]) if size else 0.0
            elif ident == SETTINGS:
                track["settings"] = bytes(data[at:stop])
            elif ident == CODEC:
                track["codec"] = data[at:stop].decode("ascii", "replace")
            elif ident == CUE_TIME:
                cue[0] = int.from_bytes(data[at:stop], "big")
            elif ident == CUE_TRACK:
                cue[1] = int.from_bytes(data[at:stop], "big")
            elif ident == CUE_CLUSTER:
                out.cues.append((cue[0], cue[1], out.segment + int.from_bytes(data[at:stop], "big")))
            if ident in _MASTERS:
                stack.append((stop, past, parent))
                past, parent = stop, ident
            else:
                at = stop
    for number, cluster, ticks, key, in_group, frames in blocks:
        at, kind = ticks * out.scale, out.tracks.get(number, {})
        for place, length in frames:
            out.packets.append((number, cluster, at, key and in_group not in referring, place, length))
            at += _lasts(kind, length)
    return out


_TRACK_NUMBERS = {TRACK_TYPE: "type", CHANNELS: "channels", DEPTH: "depth", DEFAULT_DURATION: "duration", ALGORITHM: "algorithm"}


def _lasts(track: dict[str, object], length: int) -> int:
    """Nanoseconds of a frame: the track's default, or those of its samples; 0 where neither is known."""
    if track.get("duration"):
        return int(track["duration"])
    wide = int(track.get("channels", 1)) * int(track.get("depth", 0)) // 8
    return int(length // wide * 1_000_000_000 / track["rate"]) if wide and track.get("rate") and str(track.get("codec", "")).startswith("A_PCM") else 0


def stripped(media: Media, track: int) -> bytes:
    """What header stripping took off each of the track's frames."""
    kind = media.tracks.get(track, {})
    return bytes(kind.get("settings", b"")) if kind.get("algorithm", 0) == HEADER_STRIPPING else b""


def _unknown_cluster(data: bytes, at: int, past: int) -> int:
    """Where a cluster of unknown size ends: at the next element that cannot be its child."""
    while at < past:
        ident, k = _ident(data, at)
        if ident in (CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML):
            return at
        size, k = _size(data, k)
        at = k + size
    return past


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    head = stripped(media, track)
    return b"".join([head + data[at : at + n] for number, _, _, _, at, n in media.packets if number == track])


PACKET_COLUMNS = "track long, cluster int, timestamp_ns long, key boolean, byte_offset long, byte_length long, cued boolean, stripped binary"


def packet_table(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """``id`` and one row for each packet of the file in ``content_col``, in file order; a null or unreadable file gives no rows."""

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content = batch.column(1)[row].as_py()
                try:
                    media = demux(content or b"")
                    cued = {(track, at) for _, track, at in media.cues}
                    rows = [(t, c, ns, key, at, n, (t, media.clusters[c] if media.clusters else -1) in cued, stripped(media, t) or None) for t, c, ns, key, at, n in media.packets]
                    cols = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
                except (Malformed, IndexError, OverflowError, ValueError):
                    # Numbers that are no times (NaN, infinite) or fit no column (too long) are malformed too.
                    continue
                if rows:
                    ids = batch.column(0).take(pa.array([row] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *cols], ["id", "track", "cluster", "timestamp_ns", "key", "byte_offset", "byte_length", "cued", "stripped"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary")).mapInArrow(run, f"id {kind}, {PACKET_COLUMNS}")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(samples: bytes, media: Media) -> str:
    """Integers only, so that equal payloads give equal strings: packets, clusters, cues, sum, energy about the middle, crossings, peak."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


MEDIA_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in MEDIA_COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        raw, at = utf8(batch.column(1))
        data, at = memoryview(raw), at.tolist()
        rows = []
        for k, doc in enumerate(batch.column(0).to_pylist()):
            text = bytes(data[at[k] : at[k + 1]])
            stored = mux(padded(text))
            media = demux(stored)
            back = payload(stored, media)
            rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, media)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names)
    release()


def op5_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_media_batches, MEDIA_COLUMNS)
