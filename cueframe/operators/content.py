"""Stored content: typed reading, text forms, imports, cached files, and the inputs of a step."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueframe.functions import variants

# Types that may be imported as files, and the form of a step's output reference.
FILE_TYPES = ("audio", "image", "video")
SELECTOR = r"^([a-z0-9_-]+)\.([a-z0-9_-]+)\z"


def read_as(encoding: Column, raw: Column) -> tuple[Column, Column, Column]:
    """Text (of text and JSON content), the JSON value as a variant, and the bytes (of bytes and files)."""
    text = F.decode(raw, "UTF-8")
    return F.when(encoding.isin("text", "json"), text), F.when(encoding == "json", F.try_parse_json(text)), F.when(encoding.isin("bytes", "file"), raw)


@F.pandas_udf(StringType())
def _indented(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2, sort_keys=True))


def text_form(encoding: Column, text: Column) -> Column:
    """What an export writes: JSON with two blanks of indent and sorted keys, other text as it is; null for bytes and files."""
    return F.when(encoding == "json", _indented(F.when(encoding == "json", text))).when(encoding == "text", text)


def diff_form(encoding: Column, text: Column) -> Column:
    """The text form with a line end; it is what differences are taken of."""
    shown = text_form(encoding, text)
    return F.when(shown.endswith("\n") & (encoding == "text"), shown).otherwise(F.concat(shown, F.lit("\n")))


def imported(files: DataFrame) -> DataFrame:
    """``path, kind, content`` that may be imported: file-backed kinds only, with size and hash."""
    return files.where(F.col("kind").isin(*FILE_TYPES)).select("path", "kind", F.octet_length("content").cast("long").alias("content_size"), F.sha2("content", 256).alias("content_hash"))


def refused(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(F.col("kind").isin(*FILE_TYPES), F.lit(False))).select("path", "kind")


def cache_entries(files: DataFrame, key: str, content: str) -> DataFrame:
    """What is stored beside cached files: ``key, content_size, content_hash``."""
    return files.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("content_size"), F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))


def cache_hits(wanted: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """``key, hit`` for each wanted key: a file is there, and both its size and its hash are those stored."""
    now = cache_entries(files, "key", "content").toDF("key", "size", "hash")
    rows = wanted.select("key").join(entries, "key", "left").join(now, "key", "left")
    return rows.select("key", F.coalesce((F.col("size") == F.col("content_size")) & (F.col("hash") == F.col("content_hash")), F.lit(False)).alias("hit"))


def string_fields(source: Column, names: dict[str, str]) -> Column:
    """A map of the JSON object's fields that are strings, under new names."""
    v = F.try_parse_json(source)
    pairs = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{old}", "variant")) == "STRING", F.struct(F.lit(new), F.try_variant_get(v, f"$.{old}", "string"))) for old, new in names.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def ref_kind(ref: Column) -> Column:
    """``project`` (``project.<artifact>``), ``step`` (``<step>.<output>``) or ``literal``, by the reference's form alone."""
    return F.when(ref.startswith("project."), "project").when(ref.rlike(SELECTOR), "step").otherwise("literal")


def inputs(edges: DataFrame, current: DataFrame, bound: DataFrame) -> DataFrame:
    """Inputs ``workflow_id, step, ref`` with ``kind, artifact_id, version, missing``.

    A project reference takes the artifact's current version (``artifact_id, version``), a step reference what its output is bound to (``workflow_id, name,
    artifact_id, version``); ``missing`` marks those that name nothing.
    """
    rows = edges.withColumn("kind", ref_kind(F.col("ref")))
    own = current.select(F.concat(F.lit("project."), F.col("artifact_id").cast("string")).alias("ref"), F.col("artifact_id").alias("p_id"), F.col("version").alias("p_version"))
    made = bound.select("workflow_id", F.col("name").alias("ref"), F.col("artifact_id").alias("s_id"), F.col("version").alias("s_version"))
    rows = rows.join(own, "ref", "left").join(made, ["workflow_id", "ref"], "left")
    at = lambda p, s: F.when(F.col("kind") == "project", F.col(p)).when(F.col("kind") == "step", F.col(s))
    rows = rows.select("workflow_id", "step", "ref", "kind", at("p_id", "s_id").alias("artifact_id"), at("p_version", "s_version").alias("version"))
    return rows.withColumn("missing", (F.col("kind") != "literal") & F.col("artifact_id").isNull())


def missing(found: DataFrame) -> DataFrame:
    return found.where("missing").select("workflow_id", "step", "ref")


def plugin_inputs(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Resolved inputs with ``file_path`` or ``content`` of their version (``artifact_id, version, encoding, file_path, content``), or the ``literal``."""
    stored = versions.select("artifact_id", "version", "encoding", "file_path", "content")
    rows = found.where("NOT missing").join(stored, ["artifact_id", "version"], "left")
    file = F.col("encoding") == "file"
    return rows.select(
        "workflow_id", "step", "ref", "artifact_id", "version", F.when(file, F.col("file_path")).alias("file_path"), F.when(~file, F.col("content")).alias("content"),
        F.when(F.col("kind") == "literal", F.col("ref")).alias("literal"),
    )


def parsed_replies(rows: DataFrame) -> DataFrame:
    """Corrections ``key, reply, expected`` -> ``key, items, problem``: an indexed JSON array with texts, known states and reasons, or what is wrong with it.

    Types count: a number is no text, and a reply with something after its array is no array.  Of several problems the first of: not an array, count, index, text, status, reason.
    """
    found = variants.items(variants.parsed(F.col("reply")))
    any_ = lambda test: F.exists(found, lambda x: F.coalesce(test(x), F.lit(True)))
    odd_status = lambda x: F.coalesce(variants.other_at(x, "$.status", "STRING") | ~variants.text_at(x, "$.status").isin("unchanged", "corrected", "uncertain"), variants.other_at(x, "$.status", "STRING"))
    indexes = F.transform(found, lambda x: F.when(variants.is_object(x), variants.whole_at(x, "$.index")))
    wanted = F.when(F.col("expected") > 0, F.sequence(F.lit(0).cast("long"), F.col("expected").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    problem = (
        F.when(found.isNull(), "not an array").when(F.size(found) != F.col("expected"), "count").when(~indexes.eqNullSafe(wanted), "index")
        .when(any_(lambda x: variants.text_at(x, "$.text").isNull()), "text").when(any_(odd_status), "status").when(any_(lambda x: variants.other_at(x, "$.uncertain_reason", "STRING")), "reason")
    )
    item = lambda x: F.struct(variants.whole_at(x, "$.index").cast("int").alias("index"), *[variants.text_at(x, f"$.{f}").alias(f) for f in ("text", "status", "uncertain_reason")])
    return rows.select("key", F.when(problem.isNull(), F.transform(found, item)).alias("items"), problem.alias("problem"))


def provider_models(rows: DataFrame) -> DataFrame:
    """Model lists ``provider, payload`` -> ``provider, place, id, label, context``: the first of each id, in order; the context length may stand nested.

    Elements that are no objects, or whose id is no text or empty, are passed over.  A payload without an array ``data`` gives no row; ``provider_problems`` names it.
    """
    found = rows.select("provider", F.posexplode(variants.items(variants.parsed(F.col("payload")), "$.data")).alias("place", "m")).where(variants.is_object(F.col("m")))
    m = F.col("m")
    context = F.coalesce(variants.whole_at(m, "$.context_length"), variants.whole_at(m, "$.top_provider.context_length"))
    found = found.select("provider", "place", variants.text_at(m, "$.id").alias("id"), variants.text_at(m, "$.name").alias("label"), context.alias("context")).where("id <> ''")
    first = found.groupBy("provider", "id").agg(F.min(F.struct("place", "label", "context")).alias("x"))
    return first.select("provider", F.col("x.place").cast("long").alias("place"), "id", "x.label", "x.context")


def provider_problems(rows: DataFrame) -> DataFrame:
    """``provider, problem`` of the payloads that are no object with an array ``data``."""
    value = variants.parsed(F.col("payload"))
    problem = F.when(~variants.is_object(value), "not an object").when(variants.items(value, "$.data").isNull(), "no data array")
    return rows.select("provider", problem.alias("problem")).where("problem IS NOT NULL")


def typed(rows: DataFrame, column: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """JSON records as typed columns, with ``valid``: it parses and no required field is null."""
    out = rows.withColumn("c_record", F.from_json(column, schema))
    valid = F.col("c_record").isNotNull()
    for name in required:
        valid = valid & F.col(f"c_record.{name}").isNotNull()
    return out.select(*rows.columns, "c_record.*", valid.alias("valid"))


def reported(progress: DataFrame) -> DataFrame:
    """Download reports ``status, done, total`` as ``percent``: at most 99 until finished; null where there is nothing to report."""
    moving = (F.col("status") == "downloading") & (F.col("total") > 0) & F.col("done").isNotNull()
    return progress.withColumn("percent", F.when(moving, F.least(F.col("done") / F.col("total") * 100, F.lit(99.0))).when(F.col("status") == "finished", 100.0))

