"""Times and numbers as columns; times are whole milliseconds inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; hours are not bounded."""
    ms = ms.cast("long")
    hours, rest = F.floor(ms / 3_600_000), F.pmod(ms, F.lit(3_600_000))
    minutes, seconds, part = F.floor(rest / 60_000), F.floor(F.pmod(rest, F.lit(60_000)) / 1000), F.pmod(rest, F.lit(1000))
    return F.concat(_pad(hours, 2), F.lit(":"), _pad(minutes, 2), F.lit(":"), _pad(seconds, 2), F.lit(","), _pad(part, 3))


def seconds_to_ms(seconds: Column) -> Column:
    """Half-even, as exports round."""
    return F.rint(seconds * 1000).cast("long")


def clock(ms: Column) -> Column:
    """``MM:SS.mmm``, floored, from 0 on; minutes are not bounded."""
    ms = F.greatest(F.floor(ms), F.lit(0)).cast("long")
    return F.concat(_pad(F.floor(ms / 60_000), 2), F.lit(":"), _pad(F.floor(F.pmod(ms, F.lit(60_000)) / 1000), 2), F.lit("."), _pad(F.pmod(ms, F.lit(1000)), 3))


def clock_range(first: Column, last: Column) -> Column:
    return F.concat(clock(first), F.lit(" -> "), clock(last))


def time_ms(ms: Column, seconds: Column) -> Column:
    """Milliseconds if given, else seconds; halves go up."""
    return F.floor(F.coalesce(ms.cast("double"), seconds.cast("double") * 1000) + 0.5).cast("long")


def clock_seconds(text: Column) -> Column:
    """``H:M:S.f`` as seconds; null where it is something else."""
    parts = F.split(text, ":")
    value = [F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2, 3)]
    return F.when(F.size(parts) == 3, value[0] * 3600 + value[1] * 60 + value[2])


def clamped_percent(value: Column) -> Column:
    value = value.try_cast("double")
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def percent_of(seconds: Column, duration: Column) -> Column:
    return F.when(duration > 0, clamped_percent(100 * seconds / duration)).otherwise(0.0)


def block_cps(text: Column, duration_ms: Column) -> Column:
    """Characters a second of a block: blanks count, line ends do not."""
    chars = F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.bround(chars / F.greatest(duration_ms / 1000, F.lit(0.001)), 3)


def qa_cps(text: Column, duration_ms: Column) -> Column:
    """Characters a second for quality checks: no white space counts."""
    from cueframe.functions.text import unspaced

    return F.length(unspaced(text)) / F.greatest(duration_ms / 1000, F.lit(0.001))


def bar_count(ms: Column) -> Column:
    """Bars of a waveform: 20 ms each, 240 to 24,000; 240 for no duration."""
    ms = ms.cast("double")
    return F.when(ms.isNull() | F.isnan(ms) | (ms <= 0), 240).otherwise(F.least(F.lit(24_000), F.greatest(F.lit(240), F.ceil(ms / 20)))).cast("long")
