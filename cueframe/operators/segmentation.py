"""Words into subtitle blocks: a greedy fold, short blocks merged, texts wrapped, SRT files.

Whether a word still fits depends on the block that is open, so a conversation's words are walked in order, once: folded, merged and numbered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.text import CLAUSE_MARKS, SENTENCE_MARKS, TIGHT_FIRST, TIGHT_LAST, Rule, glue, plain_token, wrapped
from cueframe.functions.timecode import block_cps, srt_time


@dataclass(frozen=True)
class Profile:
    """When a block ends; times in milliseconds."""

    max_ms: int = 6000
    min_ms: int = 800
    lines: int = 2
    chars: int = 40
    pause_ms: int = 500
    sentence: bool = True
    clause: bool = False
    merge: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.min_ms <= self.max_ms or not self.max_ms:
            raise ValueError("0 <= min_ms <= max_ms and max_ms > 0 must hold")

    @property
    def most_chars(self) -> int:
        return self.chars * self.lines


# The named profiles.
PROFILES = {
    "default": Profile(),
    "readable": Profile(max_ms=5000, chars=34, pause_ms=350, clause=True, merge=True),
    "dense": Profile(max_ms=7000, chars=44, pause_ms=650),
    "short_form": Profile(max_ms=3500, chars=28, pause_ms=250, clause=True, merge=True),
}


def protected_terms(rules: Sequence[Rule]) -> list[list[str]]:
    """Token lists of the protected plain rules' terms with two tokens or more, each once."""
    out: list[list[str]] = []
    for rule in rules:
        if rule.protected and not rule.is_regex:
            for term in (rule.source, rule.goal, *rule.aliases):
                tokens = [x for x in (re.sub(r"^\W+|\W+$", "", t).lower() for t in term.split()) if x]
                if len(tokens) > 1 and tokens not in out:
                    out.append(tokens)
    return out


def protected_spans(words: DataFrame, terms: Sequence[Sequence[str]]) -> DataFrame:
    """``words`` with ``span``: (term, first word) of the first term, then first match, that holds the word; null outside."""
    order = Window.partitionBy("conv_id").orderBy("i")
    words = words.withColumn("c_plain", plain_token(F.col("word")))
    found = []
    for k, term in enumerate(terms):
        hit = F.lit(True)
        for j, token in enumerate(term):
            hit = hit & F.coalesce((F.lead("c_plain", j).over(order) if j else F.col("c_plain")) == token, F.lit(False))
        words = words.withColumn(f"c_hit{k}", hit)
        starts = [F.when(F.lag(f"c_hit{k}", j, False).over(order) if j else F.col(f"c_hit{k}"), F.col("i") - j) for j in range(len(term) - 1, -1, -1)]
        first = F.coalesce(*starts)
        found.append(F.when(first.isNotNull(), F.struct(F.lit(k).alias("term"), first.alias("first"))))
    span = F.coalesce(*found) if found else F.lit(None).cast("struct<term:int,first:bigint>")
    return words.withColumn("span", span).drop("c_plain", *[f"c_hit{k}" for k in range(len(terms))])


def _tight(text: str, word: str) -> bool:
    return (word[:1] in TIGHT_FIRST) or (text[-1:] in TIGHT_LAST)


def _folded(p: Profile, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conv, first, last, start, end, text`` of each block, before any merging; the state is one block."""
    conv = first = last = begun = done = span = None
    text = ""
    for batch in batches:
        for now, at, start, end, word, gap, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if first is not None and now == conv:
                longer = text + word if _tight(text, word) else f"{text} {word}"
                if (span is not None and span == held) or not (
                    (done - begun >= p.min_ms and (gap >= p.pause_ms or (p.clause and text[-1:] in CLAUSE_MARKS)))
                    or (p.sentence and text[-1:] in SENTENCE_MARKS)
                    or end - begun > p.max_ms
                    or len(longer) > p.most_chars
                ):
                    last, done, text, span = at, end, longer, held
                    continue
            if first is not None:
                yield conv, first, last, begun, done, text
            conv, first, last, begun, done, text, span = now, at, at, start, end, word, held
    if first is not None:
        yield conv, first, last, begun, done, text


def _merged(p: Profile, found: Iterator[tuple]) -> Iterator[tuple]:
    """A conversation's blocks, each short one joined to the next or else to the one before, where both fit; the state is three blocks."""

    def join(a: tuple, b: tuple) -> tuple:
        return a[0], a[1], b[2], a[3], b[4], a[5] + ("" if _tight(a[5], b[5]) else " ") + b[5]

    def fits(a: tuple) -> bool:
        return a[4] - a[3] <= p.max_ms and len(a[5]) <= p.most_chars

    held, now, after = None, next(found), next(found, None)
    several = after is not None
    while now is not None:
        short = several and now[4] - now[3] < p.min_ms
        if short and after is not None and fits(both := join(now, after)):
            after = next(found, None)
            ready, held = held, both
        elif short and held is not None and fits(both := join(held, now)):
            ready, held = None, both
        else:
            ready, held = held, now
        if ready is not None:
            yield ready
        now, after = after, next(found, None)
    yield held


BLOCK_COLUMNS = "conv_id long, first_i long, last_i long, start_ms long, end_ms long, text string, block long"
BATCH_BLOCKS = 10_000


def _block_batches(p: Profile):
    """Sorted ``conv_id, i, start_ms, end_ms, word, c_gap, c_span`` -> numbered blocks, in one walk."""
    names = [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "text" else pa.int64()) for n in names])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, found in groupby(_folded(p, batches), itemgetter(0)):
            for k, block in enumerate(_merged(p, found) if p.merge and p.min_ms else found, 1):
                yield *block, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(numbered(batches), BATCH_BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def blocks(words: DataFrame, profile: Profile = PROFILES["default"], rules: Sequence[Rule] = ()) -> DataFrame:
    """``conv_id, block, first_i, last_i, start_ms, end_ms, text``: words ``conv_id, i, start_ms, end_ms, word`` in blocks, numbered from 1 in order.

    The window that measures the pauses deals the words by conversation and sorts them; the walk over its rows needs no further shuffle, and holds a few blocks,
    not a conversation.  A conversation's words are walked in one task.
    """
    order = Window.partitionBy("conv_id").orderBy("i")
    terms = protected_terms(rules)
    span = F.lit(None).cast("long")
    if terms:
        words, span = protected_spans(words, terms), F.col("span.first") * len(terms) + F.col("span.term")
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    rows = words.select("conv_id", F.col("i").cast("long").alias("i"), "start_ms", "end_ms", "word", gap.alias("c_gap"), span.alias("c_span"))
    return rows.sortWithinPartitions("conv_id", "i").mapInArrow(_block_batches(profile), BLOCK_COLUMNS)


def materialized(found: DataFrame, profile: Profile = PROFILES["default"]) -> DataFrame:
    """Blocks with wrapped text, id, line and word counts, duration and reading speed."""
    lasted = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    out = found.withColumn("text", wrapped(F.col("text"), profile.chars, profile.lines))
    lines = F.when(F.col("text") == "", 1).otherwise(F.size(F.split("text", "\n")))
    number = F.col("block").cast("string")
    return out.select(
        "conv_id", "block", F.concat(F.lit("seg_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("id"), "first_i", "last_i", "start_ms", "end_ms", "text",
        (F.col("last_i") - F.col("first_i") + 1).alias("word_count"), lines.cast("long").alias("line_count"), lasted.alias("duration_ms"), block_cps(F.col("text"), lasted).alias("cps"),
    )


def short_flags(found: DataFrame, profile: Profile) -> Column:
    return F.col("end_ms") - F.col("start_ms") < profile.min_ms


def srt(found: DataFrame) -> DataFrame:
    """``conv_id, srt``: one file's text per conversation."""
    cue = F.concat(F.col("block").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    cues = F.sort_array(F.collect_list(F.struct("block", cue.alias("cue"))))
    return found.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(cues, lambda x: x["cue"]), "\n\n"), F.lit("\n")).alias("srt"))


def run_text(tokens: Column) -> Column:
    """Tokens glued to one text."""
    return F.trim(F.aggregate(tokens, F.lit(""), lambda a, x: glue(a, x)))


def chunks(rows: DataFrame, size: int, key: str, *order: str) -> DataFrame:
    """``rows`` with ``chunk`` and ``place``: consecutive pieces of ``size`` rows of each key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("c_at", at).withColumn("chunk", F.floor(F.col("c_at") / size).cast("long")).withColumn("place", F.pmod("c_at", F.lit(size)).cast("long")).drop("c_at")
