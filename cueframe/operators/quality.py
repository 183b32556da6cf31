"""Checks of translated segments and of corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions.text import Rule, contains_term, matches, numbers
from cueframe.functions.timecode import qa_cps

MAX_LINES, MAX_CHARS, MAX_CPS = 2, 42, 20.0


def line_lengths(text: Column) -> Column:
    """Code points of each line, by any of Unicode's line ends; a final one opens no line."""
    end = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    return F.transform(F.split(F.regexp_replace(text, end + r"\z", ""), end), F.length)


def issues(segments: DataFrame, rules: Sequence[Rule] = (), max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, max_cps: float = MAX_CPS) -> DataFrame:
    """One row per issue of ``key, idx, start_ms, end_ms, source_text, text``: ``key, idx, place, code, detail``; ``place`` is the issue's order in its segment.

    The rules are parameters of the plan, so the rule join is a list of expressions and needs no shuffle.
    """
    lengths = line_lengths(F.col("text"))
    longest, count = F.array_max(lengths), F.when(F.col("text") == "", 0).otherwise(F.size(lengths))
    cps = qa_cps(F.col("text"), F.col("end_ms") - F.col("start_ms"))
    before, now = numbers(F.col("source_text")), numbers(F.col("text"))
    found = [
        F.when(count > max_lines, _issue("too_many_lines", count.cast("string"))),
        F.when(longest > max_chars, _issue("line_too_long", longest.cast("string"))),
        F.when(cps > max_cps, _issue("cps_too_high", F.bround(cps, 2).cast("string"))),
        F.when(F.to_json(before) != F.to_json(now), _issue("number_mismatch", F.concat(F.array_join(before, ","), F.lit("|"), F.array_join(now, ",")))),
    ]
    for rule in rules:
        wanted = matches(F.col("source_text"), rule) & ~contains_term(F.col("text"), rule.goal, rule.case_sensitive)
        found.append(F.when(wanted, _issue("term_mismatch", F.lit(rule.source))))
    rows = segments.select("key", "idx", F.posexplode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("place", "x"))
    return rows.select("key", "idx", F.col("place").cast("long").alias("place"), "x.code", "x.detail")


def _issue(code: str, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"))


def summary(found: DataFrame) -> DataFrame:
    """``code, issues, segments``."""
    rows = found.groupBy("code", "key", "idx").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("code").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("segments"))


def correction_counts(corrected: DataFrame) -> DataFrame:
    """``key, corrected, uncertain, segments`` over ``status``."""
    count = lambda s: F.count_if(F.col("status") == s)
    return corrected.groupBy("key").agg(count("corrected").alias("corrected"), count("uncertain").alias("uncertain"), F.count(F.lit(1)).alias("segments"))


def low_confidence(segments: DataFrame, threshold: float) -> DataFrame:
    """Segments ``key, idx, confidence, words`` (array of word, confidence) with the doubtful words and whether the segment itself is doubtful."""
    doubtful = F.filter("words", lambda w: w["confidence"] < threshold)
    return segments.select(
        "key", "idx", F.size(doubtful).cast("long").alias("low_words"), F.array_join(F.transform(doubtful, lambda w: w["word"]), " ").alias("low_text"),
        F.coalesce(F.col("confidence") < threshold, F.lit(False)).alias("below"),
    )
