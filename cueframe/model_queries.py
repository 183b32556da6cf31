"""Queries of units, stored content and read models; ``model_oracle.py`` states the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.functions import text, timecode
from cueframe.operators import artifacts, content, models, runs, segmentation, units
from cueframe.queries import SECRETS, _keyed, _log, _runs, _segments, _status, _tasks, _versions, _words, _workflows
from cueframe.sources.tables import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _now():
    return F.lit("2030-01-01").cast("timestamp")


# Units and blocks


def _spoken(spark, d) -> DataFrame:
    """Segments whose words lack times or texts by turn: blank words in turns 1 of 4, missing times in turns 2, another source text in turns 3, no words in turns 4 of 5."""
    t, odd = F.col("turn") % 4, lambda k: k % 2 == 0
    words = F.transform(
        "words",
        lambda w, k: F.struct(
            F.when((t == 1) & (k % 3 == 0), F.lit("  ")).otherwise(F.concat(F.lit(" "), w)).alias("text"),
            F.when((t == 2) & odd(k), F.lit(None)).otherwise(F.col("start_ms") + 350 * k).cast("long").alias("start_ms"),
            F.when(t == 2, F.lit(None)).otherwise(F.col("start_ms") + 350 * k + 300).cast("long").alias("end_ms"),
        ),
    )
    return _segments(spark, d).select(
        F.col("conv_id").alias("key"), F.col("turn").alias("idx"), "start_ms", "end_ms", F.concat(F.lit(" "), "text").alias("text"),
        F.when(t == 3, F.lit("other")).alias("source_text"), F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(words).alias("words"),
    )


@query
def units_fallback(spark, d):
    return units.units(_spoken(spark, d))


@query
def block_payload(spark, d):
    rows = _segments(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("segment_index"), "first_word", F.posexplode("words").alias("word_index", "text"))
    rows = rows.select("key", (F.col("first_word") + F.col("word_index")).alias("i"), "text", "segment_index", F.col("word_index").cast("long").alias("word_index"))
    out = units.payload(segmentation.blocks(_words(spark, d)), rows)
    return out.select("conv_id", "block", F.array_join(F.transform("source_segments", lambda x: x.cast("string")), ",").alias("source_segments"), F.array_join("word_refs", ",").alias("word_refs"), "word_count")


def _stored_segments(spark, d) -> DataFrame:
    lost = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 1)
    rows = _segments(spark, d).select("conv_id", F.struct("turn", (F.col("start_ms") / 1000).alias("start"), F.when(~lost, F.col("end_ms") / 1000).alias("end"), "text").alias("s"))
    rows = rows.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list("s"))).alias("content"))
    return rows.select(F.col("conv_id").alias("key"), F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit('{"segments":'), "content", F.lit("}"))).otherwise(F.col("content")).alias("content"))


@query
def segments_decoded(spark, d):
    return units.decoded(_stored_segments(spark, d)).select("key", "idx", "start_ms", "end_ms", "text", "valid")


@query
def segments_invalid(spark, d):
    return units.invalid(units.decoded(_stored_segments(spark, d)))


@query
def segments_recognised(spark, d):
    rows = _segments(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.concat(F.lit(" \n"), "text", F.lit("\t ")).alias("text"), F.lit(-0.5).alias("avg_logprob"))
    return units.recognised(rows)


@query
def run_texts(spark, d):
    return _segments(spark, d).select("conv_id", "turn", segmentation.run_text(F.col("words")).alias("text"))


# Stored content and inputs

REFS = ("step0.a", "step1.n", "step9.r", "project.999999999", "plain words", "Step0.A")


def _inputs(spark, d) -> DataFrame:
    rows = _versions(spark, d).withColumn("name", F.lower("name"))
    refs = F.array(*[F.lit(x) for x in REFS], F.concat(F.lit("project."), (F.col("workflow_id") + 1).cast("string")))
    edges = rows.select("workflow_id").distinct().select("workflow_id", F.lit("next").alias("step"), F.explode(refs).alias("ref"))
    return content.inputs(edges, artifacts.current(rows), artifacts.bindings(rows))


@query
def lineage_inputs(spark, d):
    return _inputs(spark, d)


@query
def lineage_unresolved(spark, d):
    return content.missing(_inputs(spark, d))


@query
def plugin_inputs(spark, d):
    file = F.col("artifact_id") % 3 == 0
    stored = _versions(spark, d).select(
        "artifact_id", "version", F.when(file, "file").otherwise("text").alias("encoding"), F.concat(F.lit("/store/"), F.col("artifact_id").cast("string")).alias("file_path"), F.col("content").cast("string").alias("content")
    )
    return content.plugin_inputs(_inputs(spark, d), stored)


@query
def selector_kinds(spark, d):
    rows = _versions(spark, d).select(F.explode(F.array("name", F.lower("name"), F.concat(F.lit("project."), F.lower("name")), F.lit("a.b.c"), F.lit("x_1.y-2"))).alias("ref")).distinct()
    return rows.select("ref", content.ref_kind(F.col("ref")).alias("kind"))


def _encoded(spark, d) -> DataFrame:
    kind = F.element_at(F.array(F.lit("text"), F.lit("json"), F.lit("bytes")), (F.col("event_id") % 3).cast("int") + 1)
    return table(spark, d, "events").select("event_id", kind.alias("encoding"), F.encode("props", "UTF-8").alias("raw"), "props")


@query
def typed_content(spark, d):
    shown, value, raw = content.read_as(F.col("encoding"), F.col("raw"))
    return _encoded(spark, d).select("event_id", shown.alias("text"), F.try_variant_get(value, "$.k", "bigint").alias("k"), F.octet_length(raw).cast("long").alias("bytes"))


@query
def content_text(spark, d):
    return _encoded(spark, d).select("event_id", content.text_form(F.col("encoding"), F.col("props")).alias("text"))


@query
def diff_text(spark, d):
    return _encoded(spark, d).select("event_id", content.diff_form(F.col("encoding"), F.col("props")).alias("text"))


def _files(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("audio", "text", "image", "video", "subtitle")]), (F.col("doc_id") % 5).cast("int") + 1)
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("content"))


@query
def artifact_import(spark, d):
    return content.imported(_files(spark, d))


@query
def artifact_import_refused(spark, d):
    return content.refused(_files(spark, d))


@query
def cache_probe(spark, d):
    files = _files(spark, d).select(F.col("path").alias("key"), "content")
    stored = files.withColumn("content", F.when(F.col("key") % 3 == 0, F.concat("content", F.lit("x"))).when(F.col("key") % 3 == 1, F.reverse("content")).otherwise(F.col("content")))
    return content.cache_hits(files, files.where("key % 7 > 0"), content.cache_entries(stored, "key", "content"))


@query
def string_metadata(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("webpage_url"), (F.col("page_id") % 10).alias("duration"))).alias("info"))
    found = content.string_fields(F.col("info"), {"webpage_url": "url", "duration": "duration"})
    return rows.select("page_id", found["url"].alias("url"), found["duration"].alias("duration"))


def _replies(spark, d) -> DataFrame:
    item = F.struct((F.col("idx") + F.when(F.col("key") % 11 == 0, 1).otherwise(0)).cast("int").alias("index"), F.when(F.col("key") % 13 > 0, F.col("text")).alias("text"), F.when(F.col("key") % 17 == 0, "odd").when(F.col("idx") % 2 == 0, "corrected").alias("status"))
    rows = _keyed(spark, d).select("key", "idx", item.alias("item")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("idx", "item"))).alias("x"))
    listed = F.to_json(F.transform("x", lambda i: i["item"]))
    reply = F.when(F.col("key") % 19 == 0, "{}").otherwise(listed)
    return rows.select("key", reply.alias("reply"), (F.size("x") + F.when(F.col("key") % 23 == 0, 1).otherwise(0)).alias("expected"))


@query
def correction_replies(spark, d):
    return content.parsed_replies(_replies(spark, d)).select("key", F.size("items").cast("long").alias("n"), "problem")


@query
def provider_models(spark, d):
    top = F.struct(F.col("p_size").cast("long").alias("context_length"))
    model = F.struct(F.col("p_type").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("long")).alias("context_length"), top.alias("top_provider"))
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("provider")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", model.alias("m")))).alias("x"))
    return content.provider_models(rows.select("provider", F.to_json(F.struct(F.transform("x", lambda i: i["m"]).alias("data"))).alias("payload")))


@query
def typed_records(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "{").when(F.col("event_id") % 5 == 0, '{"x":1}').otherwise(F.col("props")).alias("record"))
    return content.typed(rows, "record", "k int", ("k",)).select("event_id", "k", "valid")


@query
def download_reports(spark, d):
    status = F.element_at(F.array(F.lit("downloading"), F.lit("finished"), F.lit("error")), (F.col("event_id") % 3).cast("int") + 1)
    rows = table(spark, d, "events").select("event_id", status.alias("status"), F.col("value").alias("done"), (F.col("event_id") % 50).cast("double").alias("total"))
    return content.reported(rows).select("event_id", F.bround("percent", 6).alias("percent"))


# Lookups and records


def _wanted(rows: DataFrame, *keys: str) -> DataFrame:
    """Some keys of the table, and some that it has not."""
    first, *rest = keys
    return rows.where(F.col(first) % 97 == 0).select(*keys).unionByName(rows.where(F.col(first) % 97 == 1).select((-F.col(first)).alias(first), *rest)).distinct()


def _lookup(source, keys: list[str], *shown: str):
    def run(spark, d):
        rows = source(spark, d)
        return models.lookup(rows, _wanted(rows, *keys), keys).select(*keys, *shown, "found")

    return run


QUERIES["point_runs"] = _lookup(_runs, ["run_id"], "workflow_id", "status")
QUERIES["point_states"] = _lookup(_workflows, ["workflow_id"], "run_status")
QUERIES["point_step_runs"] = _lookup(_status, ["workflow_id", "step"], "status")
QUERIES["point_artifacts"] = _lookup(lambda s, d: artifacts.current(_versions(s, d)), ["artifact_id"], "name", "content")
QUERIES["point_versions"] = _lookup(_versions, ["artifact_id", "version"], "name", "content")
QUERIES["point_tasks"] = _lookup(_tasks, ["run_id"], "cache_key", "status")


@query
def tasks_newest_first(spark, d):
    return models.newest_first(_tasks(spark, d))


@query
def terminal_runs(spark, d):
    return _runs(spark, d).where(F.col("status").isin(*runs.TERMINAL)).select("run_id", "status")


@query
def runs_recovered(spark, d):
    return runs.recovered(_runs(spark, d)).select("run_id", "status")


@query
def run_sync(spark, d):
    states = _workflows(spark, d).select("workflow_id", F.col("run_status").alias("status"))
    return models.run_sync(_runs(spark, d), states, _log(spark, d), _now())


@query
def run_failures(spark, d):
    return models.failed(_runs(spark, d).where("status = 'running'"), _log(spark, d), _now(), F.lit("lost"), F.concat(F.lit("run "), F.col("run_id").cast("string")))


@query
def task_records(spark, d):
    tasks = _tasks(spark, d).where("run_id % 3 = 0").select("run_id", F.concat(F.lit("t"), F.col("run_id").cast("string")).alias("task_id"), F.col("updated_at").alias("created_at"))
    jobs = _runs(spark, d).where("run_id % 2 = 0").select("run_id", F.concat(F.lit("u"), F.col("workflow_id").cast("string")).alias("source_uri"))
    return models.recorded(jobs, tasks, _runs(spark, d).where("run_id % 5 > 0"), _now())


@query
def task_summaries(spark, d):
    rows = _tasks(spark, d).withColumn("source_summary", F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("s"), "cache_key"))).withColumn("source_uri", F.col("cache_key"))
    return models.task_summary(rows)


@query
def workflow_summaries(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id"))
    steps = _log(spark, d).where("step IS NOT NULL").select("workflow_id", F.col("step").alias("place"), F.concat(F.lit("s"), F.col("step").cast("string")).alias("step_id")).distinct()
    return models.workflow_summary(customers, steps, _workflows(spark, d).select("workflow_id", F.col("run_status").alias("status")), _log(spark, d))


@query
def project_info(spark, d):
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return models.projects(projects, table(spark, d, "customer").where("c_nationkey % 6 > 0").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("workflow_id")))


@query
def run_project(spark, d):
    held = table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(25)).alias("project_id"), F.col("l_orderkey").alias("run_id"))
    projects = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.pmod(F.col("n_nationkey") * 7, F.lit(25)).alias("place"))
    return models.first_project(_runs(spark, d).where("run_id % 3 = 0"), held, projects)


# Reviews


def _stored(spark, d) -> DataFrame:
    kinds = [F.lit(x) for x in ("video", "subtitle", "subtitle_segments", "asr_transcript", "audio", "translation", "note")]
    rows = table(spark, d, "part")
    kind = F.element_at(F.array(*kinds), (F.col("p_size") % 7).cast("int") + 1)
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "Translate.").otherwise("step."), "p_brand")
    return rows.select((F.col("p_partkey") % 40).alias("workflow_id"), F.col("p_partkey").alias("place"), kind.alias("kind"), name.alias("name"), F.col("p_partkey").alias("version_id"))


def _previews(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("version_id"), F.col("p_name").alias("content"), (F.col("p_partkey") % 4 == 0).alias("truncated"))


@query
def artifact_roles(spark, d):
    return _stored(spark, d).select("place", models.role(F.col("kind"), F.col("name")).alias("roles"))


@query
def first_previews(spark, d):
    return models.first_preview(_stored(spark, d), _previews(spark, d), "translation")


@query
def subtitle_previews(spark, d):
    return models.first_preview(_stored(spark, d), _previews(spark, d), "subtitle")


@query
def remote_titles(spark, d):
    videos = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("workflow_id"), F.col("p_partkey").alias("place"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("url"), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"))
    tasks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), (F.col("s_suppkey") % 40).alias("workflow_id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string"))).alias("source_uri"))
    return models.remote_title(tasks, videos)


@query
def tool_bindings(spark, d):
    kinds = F.array(F.concat(F.lit("k"), (F.col("p_size") % 9).cast("string")), F.concat(F.lit("k"), (F.col("p_size") % 11).cast("string")))
    tools = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("tool"), F.col("p_brand").alias("input"), kinds.alias("kinds"), (F.col("p_partkey") % 2 == 0).alias("required"))
    tools = tools.groupBy("tool", "input").agg(F.min_by("kinds", F.struct("kinds", "required")).alias("kinds"), F.min("required").alias("required"))
    outputs = table(spark, d, "nation").where("n_nationkey < 12").select(
        F.floor(F.col("n_nationkey") / 2).cast("long").alias("step_place"), (F.col("n_nationkey") % 2).cast("long").alias("place"), F.concat(F.lit("s"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("step_id"),
        F.lower("n_name").alias("name"), F.concat(F.lit("k"), (F.col("n_nationkey") % 7).cast("string")).alias("kind"),
    )
    return models.bound_tools(tools, outputs)


@query
def autosave_status(spark, d):
    saved = F.when((F.col("turn") == 2) & (F.col("conv_id") % 5 == 0), "error").when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), "saving").otherwise("saved")
    return models.save_status(table(spark, d, "conversations").select(F.col("conv_id").alias("key"), saved.alias("saved")))


@query
def payload_complete(spark, d):
    rows = table(spark, d, "part").select((F.col("p_partkey") % 500).alias("key"), F.substring("p_brand", 7, 1).alias("name"))
    return models.complete(rows, ("1", "2", "3"))


@query
def artifact_counts(spark, d):
    return models.artifact_counts(artifacts.bindings(_versions(spark, d)))


@query
def tool_catalog(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(".", "p_brand", "p_partkey").alias("ref"), F.pmod("p_size", F.lit(4)).cast("int").alias("outputs"))
    return models.tool_catalog(rows)


def _steps(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("s"), F.pmod("l_linenumber", F.lit(9)).cast("string")).alias("step_id"), F.col("l_linenumber").cast("long").alias("place"))


@query
def step_reorder(spark, d):
    order = spark.sql("SELECT * FROM VALUES ('s5', 0), ('s2', 1), ('s77', 2) AS t(step_id, wanted)")
    return models.reordered(_steps(spark, d), order)


@query
def default_model_first(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("provider"), F.col("s_suppkey").alias("model"), F.col("s_suppkey").alias("place"))
    return models.default_first(rows, F.col("provider") + 50)


@query
def extra_steps(spark, d):
    rows = _steps(spark, d).select("workflow_id", "step_id", F.when(F.col("workflow_id") % 2 == 0, "remote").otherwise("local").alias("kind"), (F.col("place") != 4).alias("enabled"))
    base = spark.sql("SELECT * FROM VALUES ('remote', 's1'), ('remote', 's2'), ('local', 's2') AS t(kind, step_id)")
    return models.extra_steps(rows, base)


def _shown(spark, d) -> DataFrame:
    task = F.element_at(F.array(*[F.lit(x) for x in ("failed", "running", "completed", "paused", "queued", "aborted", "draft")]), F.pmod("workflow_id", F.lit(7)).cast("int") + 1)
    return models.normalized_progress(_status(spark, d).withColumn("task_status", task))


@query
def progress_shown(spark, d):
    return _shown(spark, d).select("workflow_id", "step", "shown")


@query
def progress_summary(spark, d):
    return models.step_summary(_shown(spark, d))


@query
def plugin_events(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("workflow_id"), F.col("turn").alias("ts"), F.col("turn").alias("event_id"), F.col("text").alias("message"))
    return models.plugin_events(rows, SECRETS)


@query
def segment_progress(spark, d):
    t = (F.col("start_ms") + F.col("end_ms")) / 2 + (F.col("conv_id") % 5 - 2) * 300
    swap = F.col("turn") % 2 == 0
    first, last = F.when(swap, F.col("end_ms")).otherwise(F.col("start_ms")), F.when(swap, F.col("start_ms")).otherwise(F.col("end_ms"))
    return _segments(spark, d).select("conv_id", "turn", F.bround(models.segment_progress(t, first, last), 6).alias("part"))


@query
def placeholder_waveform(spark, d):
    return models.placeholder_bars(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") + 40).alias("n")), F.lit(48))


@query
def visible_bars(spark, d):
    rows = _segments(spark, d).select(F.col("conv_id").alias("key"), "turn", F.col("start_ms").alias("left"), F.lit(900).alias("width"), (F.col("end_ms") + 100).alias("total_px"), F.floor((F.col("end_ms") + 100) / 4).alias("bars"))
    return models.visible_bars(rows.withColumn("key", F.col("key") * 1000 + F.col("turn")), 4, 200)


@query
def retry_next(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", models.retries(F.col("text"), F.col("conv_id") % 9 == 0, F.col("turn") % 4 == 0, F.col("turn") < 5, ("que", "the")).alias("again"))


@query
def hotwords(spark, d):
    words = F.transform("words", lambda w: F.when(F.length(w) > 4, F.concat(F.lit(" "), w)).otherwise(F.lit(" ")))
    return _segments(spark, d).select("conv_id", "turn", models.hotwords(words).alias("hotwords"))


@query
def step_lines(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", models.step_line(F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")), F.when(F.col("p_partkey") % 4 > 0, F.replace("p_name", F.lit(" "), F.lit("_")))).alias("line"))


@query
def tool_titles(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", models.tool_title(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 5 == 0, "qa").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("title"))


@query
def progress_lines(spark, d):
    k = F.col("event_id") % 4
    value = F.col("event_id").cast("string")
    clock = F.concat(F.lit("1:"), (F.col("event_id") % 60).cast("string"), F.lit(":2.5"))
    line = F.when(k == 0, F.concat(F.lit("out_time_ms="), value)).when(k == 1, F.concat(F.lit(" out_time_us=-"), value)).when(k == 2, F.concat(F.lit("out_time="), clock)).otherwise(F.concat(F.lit("frame="), value))
    return table(spark, d, "events").select("event_id", models.progress_seconds(line).alias("seconds"))


@query
def clock_times(spark, d):
    rows = table(spark, d, "events")
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25Z"))
    return rows.select("event_id", models.short_time(F.when(F.col("event_id") % 4 > 0, shown).otherwise("soon")).alias("time"), timecode.time_ms(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.col("value")).alias("ms"))


@query
def probed_durations(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", models.probed_seconds(F.when(F.col("event_id") % 3 > 0, F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".5\n"))).otherwise("N/A\n")).alias("seconds"))


@query
def language_codes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("lang")).alias("name"))
    return rows.select("doc_id", text.language_code(F.col("name"), {"en": "eng", "de": "deu"}).alias("code"))
