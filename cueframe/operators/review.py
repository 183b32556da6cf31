"""Review models: source and translated segments side by side, look-ups by time, waveforms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.timecode import bar_count

# Levels of a bar, and the noise floor of -45 dB.
LEAST_LEVEL, MOST_LEVEL, FLOOR = 4, 96, 10 ** (-45 / 20)


def _said(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def aligned(source: DataFrame, translated: DataFrame) -> DataFrame:
    """``key, idx, start_ms, end_ms, source_text, text``: a full outer join by place; the translation's times count first, and segments that end before they start go."""
    a = source.select("key", "idx", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), F.col("text").alias("c_text"))
    b = translated.select("key", "idx", "start_ms", "end_ms", "source_text", "text")
    rows = a.join(b, ["key", "idx"], "full_outer")
    out = rows.select(
        "key", "idx", F.coalesce("start_ms", "c_start", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", "c_end", F.lit(0)).alias("end_ms"),
        _said(F.col("c_text"), F.col("source_text"), F.col("text")).alias("source_text"), _said(F.col("text"), F.col("c_text")).alias("text"),
    )
    return out.where("end_ms >= start_ms")


def duration(segments: DataFrame) -> DataFrame:
    return segments.groupBy("key").agg(F.greatest(F.max("end_ms"), F.lit(1)).alias("duration_ms"))


def at_time(segments: DataFrame, times: DataFrame) -> DataFrame:
    """``key, t, idx``: of ``segments`` (``key, idx, start_ms, end_ms``) the first by start that holds t, else the last that starts by then, else the first.

    Segments and times are sorted once by (key, time) and walked batch by batch, so no pair is formed and no key is gathered.  Only segments that end later than all before them can be
    the first that holds a time; they wait in a queue until times pass their ends.
    """
    column = lambda name: F.col(name).cast("long")
    none = F.lit(None).cast("long")
    kind_of = segments.schema["idx"].dataType
    seg = segments.select("key", column("start_ms").alias("at"), F.lit(1).alias("kind"), column("idx").alias("idx"), column("end_ms").alias("c_end"))
    ask = times.select("key", column("t").alias("at"), F.lit(2).alias("kind"), none.alias("idx"), none.alias("c_end"))
    # The first segment of a key comes before its times.
    first = seg.where("idx IS NOT NULL").groupBy("key").agg(F.min(F.struct("at", "idx")).alias("x")).select("key", none.alias("at"), F.lit(0).alias("kind"), F.col("x.idx").alias("idx"), none.alias("c_end"))
    rows = first.unionByName(seg).unionByName(ask).repartition("key").sortWithinPartitions("key", "at", "kind", "idx")
    found = rows.mapInArrow(_held_at, rows.select("key", F.col("at").alias("t"), "idx").schema)
    return found.select("key", F.col("t").cast(times.schema["t"].dataType).alias("t"), F.col("idx").cast(kind_of).alias("idx"))


def _held_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the sorted rows of ``at_time``; kinds are 0 a key's first segment, 1 a segment, 2 a time."""
    now, begun, first, last, most, asked = None, False, None, None, None, ()
    records: deque[tuple] = deque()
    for batch in batches:
        at_rows, found = [], []
        for row, (key, at, kind, idx, end) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
            if not begun or key != now:
                now, begun, first, last, most, asked = key, True, None, None, None, ()
                records.clear()
            if kind == 0:
                first = idx
            elif kind == 1:
                last = last if idx is None else idx
                if end is not None and (most is None or end > most):
                    most = end
                    if idx is not None:
                        records.append((end, idx, at))
            elif asked != (at,):
                asked, held = (at,), None
                if at is not None:
                    while records and records[0][0] < at:
                        records.popleft()
                    if records and records[0][2] is not None:
                        held = records[0][1]
                at_rows.append(row)
                found.append(held if held is not None else last if last is not None else first)
        taken = pa.array(at_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(found, pa.int64())], ["key", "t", "idx"])


def bar_levels(samples: DataFrame, bars: int) -> DataFrame:
    """``bar, level`` of ``samples`` (``frame, value`` in -1..1): root mean square per bar over the noise floor, scaled by the loudest bar."""
    count = samples.agg(F.count(F.lit(1)).alias("n"))
    # Frame f lies in the bars i with floor(i n / bars) <= f < floor((i + 1) n / bars), or, of more bars than frames, in all that begin at it.
    last = F.expr(f"((frame + 1) * {bars}L - 1) div n")
    first = F.least(F.expr(f"(frame * {bars}L + n - 1) div n"), last)
    framed = samples.crossJoin(F.broadcast(count)).withColumn("bar", F.explode(F.sequence(first, last)))
    sums = framed.groupBy("bar").agg(F.avg(F.col("value") * F.col("value")).alias("c_square"))
    rms = sums.select("bar", F.sqrt("c_square").alias("rms"))
    # One row per bar, so the window over all of them is of a set size.
    return rms.withColumn("c_peak", F.max("rms").over(Window.partitionBy(F.lit(1)))).select("bar", _level().alias("level"))


def _level() -> Column:
    """The level of a bar of ``rms`` among bars of which ``c_peak`` is the loudest."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rms") - FLOOR) / F.greatest(F.col("c_peak") - FLOOR, F.lit(2.220446049250313e-16))))
    level = F.floor(LEAST_LEVEL + F.sqrt(share) * (MOST_LEVEL - LEAST_LEVEL) + 0.5).cast("long")
    return F.when((F.col("c_peak") <= FLOOR) | (F.col("rms") <= FLOOR), F.lit(0)).otherwise(level)


SUMS = "path string, bar long, squares long, n long"
_SUMS = pa.schema([("path", pa.string()), ("bar", pa.int64()), ("squares", pa.int64()), ("n", pa.int64())])


def bar_sums(squares: np.ndarray, first: int, frames: int, bars: int, channels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bar, squares, n`` of the bars that the frames from ``first`` on, of ``frames``, have a part in: differences of prefix sums at the bars' edges, and samples counted."""
    past = first + len(squares)
    total = np.concatenate([[0], np.cumsum(squares)])
    low = max(0, first * bars // frames - 1)
    bar = np.arange(low, min(bars, past * bars // frames + 1))
    begin = bar * frames // bars
    end = np.maximum(begin + 1, (bar + 1) * frames // bars)
    a, b = np.clip(begin, first, past) - first, np.clip(end, first, past) - first
    held = b > a
    return bar[held], (total[b] - total[a])[held], ((b - a) * channels)[held]


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta = zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)
        for (path, channels, frames, first, bars), samples in zip(meta, batch.column(5), strict=True):
            values = np.asarray(samples.values).astype(np.int64)
            bar, squares, n = bar_sums((values * values).reshape(-1, channels).sum(1), first, frames, bars, channels)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(bar), pa.string()), pa.array(bar), pa.array(squares), pa.array(n)], schema=_SUMS)


def file_levels(samples: DataFrame, bars: int | None = None) -> DataFrame:
    """``path, bar, level`` of rows of samples (as ``media.read_wav`` gives them), each file by its own loudest bar; without ``bars`` as many as its duration calls for.

    Rows of samples are summed where they are read, in whole numbers, and one small row for each bar that a row has a part in is shuffled; no sample becomes a row.  Files that
    could not be read have no bars.
    """
    count = F.lit(bars).cast("long") if bars else bar_count(F.col("frames") * 1000 / F.nullif(F.col("rate"), F.lit(0)))
    rows = samples.where(F.col("reason").isNull()).select("path", "channels", "frames", "first_frame", count.alias("bars"), "samples")
    sums = rows.mapInArrow(_row_sums, SUMS).groupBy("path", "bar").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    rms = sums.select("path", "bar", (F.sqrt(F.col("squares").cast("double") / F.col("n")) / 32768).alias("rms"))
    return rms.withColumn("c_peak", F.max("rms").over(Window.partitionBy("path"))).select("path", "bar", _level().alias("level"))


def pooled(bars: DataFrame, width: int) -> DataFrame:
    """Means of ``width`` neighbouring bars."""
    return bars.groupBy(F.floor(F.col("bar") / width).cast("long").alias("bar")).agg(F.avg("level").alias("level"))
