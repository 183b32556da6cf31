"""What is written for users, as rows ``name, content`` of files: subtitle files, exported versions, event lines, cached files with their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions.timecode import srt_time
from cueframe.operators import content


def srt_files(found: DataFrame) -> DataFrame:
    """Blocks ``conv_id, block, start_ms, end_ms, text`` in order, a conversation's together (as ``segmentation.blocks`` gives them): a row for each cue, a file for each conversation.

    Cues stand apart by an empty line and the file ends with a line end, so each row is a cue with its line end, and from the second on a line end before it; nothing is gathered.
    """
    cue = F.concat_ws("\n", F.col("block").cast("string"), F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms"))), F.coalesce("text", F.lit("")))
    return found.select(F.concat(F.col("conv_id").cast("string"), F.lit(".srt")).alias("name"), F.concat(F.when(F.col("block") > 1, "\n").otherwise(""), cue, F.lit("\n")).alias("content"))


def export_files(versions: DataFrame, name: Column) -> DataFrame:
    """``version_id, encoding, raw`` as files: bytes as they are, text and JSON in the text form.  File-backed versions are none of them (``export_refused``)."""
    text, _, raw = content.read_as(F.col("encoding"), F.col("raw"))
    said = F.coalesce(F.when(F.col("encoding") == "bytes", raw), F.encode(content.text_form(F.col("encoding"), text), "UTF-8"))
    return versions.where(~_file_backed()).select(name.alias("name"), said.alias("content"))


def export_refused(versions: DataFrame) -> DataFrame:
    """``version_id, reason`` of the versions that cannot be exported."""
    return versions.where(_file_backed()).select("version_id", F.lit("only stored text, JSON and bytes are exported").alias("reason"))


def _file_backed() -> Column:
    return ~F.coalesce(F.col("encoding").isin("text", "json", "bytes"), F.lit(False))


def event_line(message: Column) -> Column:
    """``sequence type message`` without blanks at its ends."""
    return F.trim(F.concat(F.col("sequence").cast("string"), F.lit(" "), F.col("type"), F.lit(" "), F.coalesce(message, F.lit(""))))


def event_files(log: DataFrame, message: Column) -> DataFrame:
    """The lines of each workflow's events in order of ``sequence``, a file for each workflow, a row for each line."""
    rows = log.select("workflow_id", "sequence", event_line(message).alias("line"))
    rows = rows.repartition("workflow_id").sortWithinPartitions("workflow_id", "sequence")
    return rows.select(F.concat(F.col("workflow_id").cast("string"), F.lit(".log")).alias("name"), F.concat("line", F.lit("\n")).alias("content"))


def cache_files(files: DataFrame, source: Column) -> DataFrame:
    """``key, content`` as ``<key>/content`` and, beside it, ``<key>/metadata.json`` with its size, hash and source; both are there after the commit, or neither."""
    size, digest = F.octet_length("content").cast("long"), F.sha2(F.col("content").cast("binary"), 256)
    stored = F.to_json(F.struct(F.col("key").cast("string").alias("cache_key"), digest.alias("content_hash"), size.alias("content_size"), F.lit(1).alias("schema_version"), source.alias("source_metadata")))
    both = F.array(F.struct(F.lit("content").alias("part"), F.col("content").cast("binary").alias("content")), F.struct(F.lit("metadata.json").alias("part"), stored.cast("binary").alias("content")))
    rows = files.select(F.col("key").cast("string").alias("key"), F.explode(both).alias("file"))
    return rows.select(F.concat("key", F.lit("/"), "file.part").alias("name"), F.col("file.content").alias("content"))


def cached(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files read back -> ``key, content`` and the entries ``key, content_size, content_hash`` that ``content.cache_hits`` compares."""
    key, part = F.substring_index("name", "/", 1), F.substring_index("name", "/", -1)
    entry = F.from_json(F.col("content").cast("string"), "content_size long, content_hash string")
    return (
        read.where(part == "content").select(key.alias("key"), "content"),
        read.where(part == "metadata.json").select(key.alias("key"), entry.alias("e")).select("key", "e.*"),
    )
