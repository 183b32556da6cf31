"""Timed segments from JSON, their units, and what a block of units stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import variants
from cueframe.functions.text import tokens

def raw_segments(content: Column) -> Column:
    """The objects of a JSON array, or of an object's ``segments``; empty for anything else.  Elements that are no objects, and fields of other types, are lost alone."""
    value = variants.parsed(content)
    listed = F.filter(F.coalesce(variants.items(value, "$.segments"), variants.items(value)), variants.is_object)
    number, text = variants.number_at, variants.text_at
    word = lambda w: F.struct(text(w, "$.text").alias("text"), number(w, "$.start").alias("start"), number(w, "$.end").alias("end"), number(w, "$.confidence").alias("confidence"))
    segment = lambda s: F.struct(
        number(s, "$.start").alias("start"), number(s, "$.end").alias("end"), text(s, "$.text").alias("text"), text(s, "$.source_text").alias("source_text"), number(s, "$.confidence").alias("confidence"),
        F.transform(variants.objects(s, "$.words"), word).alias("words"),
    )
    return F.transform(F.coalesce(listed, F.filter(F.array(value), lambda v: F.lit(False))), segment)


def decoded(rows: DataFrame) -> DataFrame:
    """``key, content`` -> ``key, idx, start_ms, end_ms, text, source_text, confidence, words, valid``; a segment without start or end is not valid."""
    out = rows.select("key", F.posexplode(raw_segments(F.col("content"))).alias("idx", "s"))
    ms = lambda c: F.rint(c * 1000).cast("long")
    words = F.transform("s.words", lambda w: F.struct(w["text"].alias("text"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms"), w["confidence"].alias("confidence")))
    return out.select(
        "key", F.col("idx").cast("long").alias("idx"), ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), F.coalesce("s.text", F.lit("")).alias("text"), "s.source_text", "s.confidence",
        words.alias("words"), (F.col("s.start").isNotNull() & F.col("s.end").isNotNull()).alias("valid"),
    )


def invalid(segments: DataFrame) -> DataFrame:
    """``key, missing`` of the keys that hold segments without start or end."""
    return segments.where(~F.col("valid")).groupBy("key").agg(F.count(F.lit(1)).alias("missing"))


def recognised(segments: DataFrame) -> DataFrame:
    """Rows of a recogniser, ``key, idx, start, end, text, avg_logprob``: times as numbers, texts stripped, the log-probability as confidence."""
    return segments.select("key", "idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), stripped(F.col("text")).alias("text"), F.col("avg_logprob").alias("confidence"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def units(segments: DataFrame) -> DataFrame:
    """``key, i, start_ms, end_ms, text, segment_index, word_index`` in order of ``key, idx``.

    A segment's words are its units if it has any that is not blank and its text is its source text (or there is none); a word without a start takes the
    segment's, one without an end its own start.  Else the segment is one unit, with a null ``word_index``, unless its text is blank.
    """
    text = stripped(F.col("text"))
    split = F.col("source_text").isNull() | (F.col("source_text") == text)
    said = F.filter(
        F.transform(F.coalesce("words", F.array()), lambda w, k: F.struct(
            k.cast("long").alias("word_index"), F.coalesce(w["start_ms"], F.col("start_ms")).alias("start_ms"),
            F.coalesce(w["end_ms"], w["start_ms"], F.col("start_ms")).alias("end_ms"), stripped(w["text"]).alias("text"))),
        lambda u: u["text"] != "",
    )
    whole = F.struct(F.lit(None).cast("long").alias("word_index"), F.col("start_ms"), F.col("end_ms"), text.alias("text"))
    found = F.when(split & (F.size(said) > 0), said).when(text != "", F.array(whole)).otherwise(F.slice(said, 1, 0))
    rows = segments.select("key", F.col("idx").alias("segment_index"), F.explode(found).alias("u")).select("key", "segment_index", "u.*")
    order = Window.partitionBy("key").orderBy("segment_index", "word_index")
    return rows.select("key", (F.row_number().over(order) - 1).cast("long").alias("i"), "start_ms", "end_ms", "text", "segment_index", "word_index")


def payload(found: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks ``conv_id, block, first_i, last_i`` with ``source_segments, word_refs`` (each once, in order) and ``word_count`` over the units' tokens."""
    at = found.select("conv_id", "block", F.explode(F.sequence("first_i", "last_i")).alias("i"))
    rows = at.join(units.select(F.col("key").alias("conv_id"), "i", "text", "segment_index", "word_index"), ["conv_id", "i"])
    inner = F.sort_array(F.collect_list(F.struct("i", "segment_index", "word_index")))
    out = rows.groupBy("conv_id", "block").agg(inner.alias("u"), F.sum(F.size(tokens(F.col("text")))).alias("word_count"))
    refs = F.transform(F.filter("u", lambda x: x["word_index"].isNotNull()), lambda x: F.concat_ws(":", x["segment_index"].cast("string"), x["word_index"].cast("string")))
    return out.select("conv_id", "block", F.array_distinct(F.transform("u", lambda x: x["segment_index"])).alias("source_segments"), F.array_distinct(refs).alias("word_refs"), "word_count")
