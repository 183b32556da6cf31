"""WAV files by shares of their frames, bad files as rows, levels without a row for each sample."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueframe.operators import review
from cueframe.sources import media


def brute_levels(samples, channels, bars):
    """Frame by frame, from the definition."""
    frames = len(samples) // channels
    rms = []
    for i in range(bars):
        a = i * frames // bars
        b = max(a + 1, (i + 1) * frames // bars)
        part = [int(s) for s in samples[a * channels : min(b, frames) * channels]]
        rms.append((sum(x * x for x in part) / len(part)) ** 0.5 / 32768 if part else 0)
    peak, floor = max(rms), review.FLOOR
    share = lambda r: min(1, max(0, (r - floor) / max(peak - floor, 2.220446049250313e-16)))
    return [0 if peak <= floor or r <= floor else int(4 + share(r) ** 0.5 * 92 + 0.5) for r in rms]


def put(folder, files):
    folder.mkdir(exist_ok=True)
    for name, raw in files.items():
        (folder / name).write_bytes(raw)
    return str(folder)


def levels(frame):
    out = {}
    for r in frame.orderBy("path", "bar").collect():
        out.setdefault(r.path, []).append(r.level)
    return out


def test_a_silent_middle(spark, tmp_path):
    loud = [8000, -8000] * 1500
    path = put(tmp_path / "w", {"a.wav": media.wav_bytes(loud + [0] * 3000 + loud, 16_000)})
    assert levels(review.file_levels(media.read_wav(spark, path), 9)) == {"a.wav": [96] * 3 + [0] * 3 + [96] * 3}


def test_shares_and_rows_do_not_change_the_levels(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    made = {"mono.wav": (rng.integers(-32768, 32768, 10_007), 1), "stereo.wav": (rng.integers(-3000, 3000, 8_006), 2), "short.wav": (np.array([100, -32768, 3]), 1), "still.wav": (np.zeros(500), 1)}
    path = put(tmp_path / "w", {n: media.wav_bytes(s, 8000, c) for n, (s, c) in made.items()})
    wanted = {n: brute_levels(s, c, 64) for n, (s, c) in made.items()}
    for share in (1000, 1 << 20):
        rows = media.read_wav(spark, path, share)
        assert levels(review.file_levels(rows, 64)) == wanted
        got = {}
        for r in sorted(rows.collect(), key=lambda r: (r.path, r.first_frame)):
            got.setdefault(r.path, []).extend(r.samples)
        assert all(got[n] == list(map(int, s)) for n, (s, c) in made.items())
    assert media.read_wav(spark, path, 1000).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_sums_at_the_edges_of_bars(rows):
    rng = random.Random(rows)
    for _ in range(60):
        frames, bars = rng.randint(1, 90), rng.randint(1, 130)
        squares = np.array([rng.randint(0, 9) for _ in range(frames)])
        total = {}
        for a in range(0, frames, rows):
            for bar, s, n in zip(*review.bar_sums(squares[a : a + rows], a, frames, bars, 1), strict=True):
                total[bar] = tuple(x + y for x, y in zip(total.get(bar, (0, 0)), (int(s), int(n)), strict=True))
        for bar in range(bars):
            begin = bar * frames // bars
            part = squares[begin : max(begin + 1, (bar + 1) * frames // bars)]
            assert total.get(bar, (0, 0)) == (part.sum(), len(part))


def test_bad_files_are_rows_with_a_reason(spark, tmp_path):
    good = media.wav_bytes(range(100), 8000)
    files = {
        "good.wav": good, "empty.wav": b"", "text.wav": b"x" * 60, "cut.wav": good[:-10], "nodata.wav": media.wav_bytes([], 8000), "float.wav": good[:20] + b"\x03" + good[21:],
        "narrow.wav": good[:32] + b"\x01\x00" + good[34:], "mute.wav": good[:22] + b"\x00\x00" + good[24:],
    }
    rows = media.read_wav(spark, put(tmp_path / "w", files), 64)
    bad = {r.path: r.reason for r in rows.where("reason IS NOT NULL").collect()}
    assert bad == {
        "empty.wav": "shorter than a header", "text.wav": "no WAVE file", "cut.wav": "a chunk goes beyond the end", "nodata.wav": "no format or no samples", "float.wav": "not 16-bit PCM",
        "narrow.wav": "frames overlap", "mute.wav": "not 16-bit PCM",
    }
    assert set(levels(review.file_levels(rows, 3))) == {"good.wav"}
    assert rows.where("path = 'good.wav'").agg(F.sum(F.size("samples"))).first()[0] == 100
    assert media.read_wav(spark, str(tmp_path / "never")).count() == 0


def test_extra_chunks_and_wide_frames():
    body = np.arange(12, dtype="<i2").tobytes()
    chunk = lambda name, raw: name + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) % 2)
    form = b"\x01\0\x01\0" + (8000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + b"\x04\0\x10\0"
    raw = b"RIFF\0\0\0\0WAVE" + chunk(b"LIST", b"odd") + chunk(b"fmt ", form + b"\0\0") + chunk(b"data", body)
    file = pa.BufferReader(raw)
    found = media.wav_form(file, len(raw))
    assert (found.frames, found.width, found.rate) == (6, 4, 8000)
    assert media.frames_of(file, found, 1, 4).tolist() == [2, 4, 6]


def test_flipped_bytes_never_fail():
    rng, good = random.Random(1), media.wav_bytes(range(-40, 40), 8000, 2)
    for _ in range(3000):
        raw = bytearray(good[: rng.choice([len(good), rng.randint(0, len(good))])])
        for _ in range(rng.randint(1, 4)):
            if raw:
                raw[rng.randrange(len(raw))] = rng.randrange(256)
        file = pa.BufferReader(bytes(raw))
        try:
            form = media.wav_form(file, len(raw))
        except ValueError:
            continue
        assert len(media.frames_of(file, form, 0, form.frames)) == form.frames * form.channels


def test_bars_follow_the_duration(spark, tmp_path):
    path = put(tmp_path / "w", {"s.wav": media.wav_bytes([1] * 800, 8000), "l.wav": media.wav_bytes([1] * 10_000, 1000), "r.wav": media.wav_bytes([1] * 10, 0)})
    assert {p: len(x) for p, x in levels(review.file_levels(media.read_wav(spark, path))).items()} == {"s.wav": 240, "l.wav": 500, "r.wav": 240}


def test_many_small_shares_are_few_tasks(spark, tmp_path):
    """A task for each small share made tasks with the files: 300 files of three shares were 600 tasks and more."""
    made = {f"{k}.wav": media.wav_bytes(range(k, k + 1400), 8000) for k in range(300)}
    rows = media.read_wav(spark, put(tmp_path / "w", made), 1000)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert rows.agg(F.countDistinct("path"), F.sum(F.size("samples")), F.max(F.size("samples"))).first() == (300, 300 * 1400, 467)
