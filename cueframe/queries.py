"""One query per operator over the driver's tables; ``oracle.py`` states the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.functions import hashing, text, timecode
from cueframe.functions.text import Rule
from cueframe.operators import artifacts, catalog, events, quality, review, runs, segmentation, translation
from cueframe.sources.tables import artifact_versions, table, timed_segments, timed_words, workflow_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The glossary of the queries: a word with an alias, a regular expression with a group, a term where case counts.
RULES = (Rule("que", "QUE", aliases=("und", " the ")), Rule(r"([a-z]+)tion", r"\1sion", is_regex=True), Rule("De", "Of", case_sensitive=True))
QA_RULES = (Rule("the", "ing"), Rule("La", "de", case_sensitive=True))
PROTECTED = (Rule("of the", protected=True), Rule("de la que", protected=True))
SECRETS = ("que", "the")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return timed_segments(_conversations(spark, d))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return timed_words(_segments(spark, d))


def _translated(spark: SparkSession, d: str) -> DataFrame:
    """Segments with numbers in them: every third translation has another number, every fifth a line break more."""
    said = F.concat(F.lit("[zh] "), "text", F.lit(" "), (F.col("turn") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).cast("string"), F.when(F.col("conv_id") % 5 == 0, F.lit("\n\nx")).otherwise(""))
    source = F.concat("text", F.lit(" "), F.col("turn").cast("string"))
    return _segments(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), "start_ms", "end_ms", source.alias("source_text"), said.alias("text"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), "text")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return workflow_events(table(spark, d, "events"))


def _workflows(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(x) for x in ("completed", "running", "queued", "failed")]), F.pmod("workflow_id", F.lit(4)).cast("int") + 1)
    return _log(spark, d).select("workflow_id").distinct().withColumn("run_status", state)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    started = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("workflow_id"), status.alias("status"), started.alias("started_at"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 7 == 0, "aborted").when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("running")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("cache_key"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return artifact_versions(table(spark, d, "lineitem"))


def _files_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("content"))


# Timed text


@query
def glossary_replace(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", text.glossary(F.col("text"), RULES).alias("text"))


@query
def glossary_word_counts(spark, d):
    rows = glossary_replace(spark, d)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.size(text.tokens(F.col("text")))).alias("words"), F.lit(len(RULES)).cast("long").alias("rules"))


@query
def glossary_matches(spark, d):
    rows = _conversations(spark, d).select("conv_id", "turn", F.array(*[F.when(text.matches(F.col("text"), r), F.lit(k)) for k, r in enumerate(RULES)]).alias("m"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(F.filter("m", lambda x: x.isNotNull()), lambda x: x.cast("string")), ",").alias("rules"))


@query
def segment_units(spark, d):
    return _words(spark, d)


def _blocks(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        profile = segmentation.PROFILES[name]
        return segmentation.materialized(segmentation.blocks(_words(spark, d), profile), profile).drop("first_i", "last_i")

    return run


for _name in segmentation.PROFILES:
    QUERIES[f"segment_blocks_{_name}"] = _blocks(_name)


@query
def segment_protected_terms(spark, d):
    return segmentation.blocks(_words(spark, d), rules=PROTECTED).select("conv_id", "block", "first_i", "last_i", "text")


@query
def segment_short_blocks(spark, d):
    found = segmentation.blocks(_words(spark, d))
    return found.where(segmentation.short_flags(found, segmentation.PROFILES["default"])).groupBy("conv_id").agg(F.count(F.lit(1)).alias("short"))


@query
def wrap_lines(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", text.wrapped(F.col("text"), 40, 3).alias("text"))


@query
def srt_timecodes(spark, d):
    return _segments(spark, d).select("conv_id", "turn", timecode.srt_time(F.col("start_ms")).alias("start"), timecode.srt_time(F.col("end_ms")).alias("end"), timecode.clock_range(F.col("start_ms"), F.col("end_ms")).alias("clock"))


@query
def srt_export(spark, d):
    return segmentation.srt(segmentation.materialized(segmentation.blocks(_words(spark, d))))


@query
def chunk_segments(spark, d):
    return segmentation.chunks(_keyed(spark, d), 2, "key", "idx").groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))


@query
def transcript_duration(spark, d):
    return _segments(spark, d).groupBy("conv_id").agg(F.max_by("end_ms", "turn").alias("duration_ms"))


# Translation and its quality


@query
def qa_issues(spark, d):
    return quality.issues(_translated(spark, d), QA_RULES)


@query
def qa_summary(spark, d):
    return quality.summary(quality.issues(_translated(spark, d), QA_RULES))


@query
def qa_documents_numbers(spark, d):
    found = text.numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("numbers")).where("n > 0")


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("unchanged"), F.lit("corrected"), F.lit("uncertain")), F.pmod(F.col("idx") + F.length("text"), F.lit(3)).cast("int") + 1)
    return _keyed(spark, d).withColumn("status", status)


@query
def correction_status_counts(spark, d):
    return quality.correction_counts(_corrected(spark, d))


@query
def low_confidence_words(spark, d):
    words = F.transform("words", lambda w: F.struct(w.alias("word"), (F.pmod(F.length(w) * 37, F.lit(100)) / 100).alias("confidence")))
    rows = _segments(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), (F.pmod("start_ms", F.lit(100)) / 100).alias("confidence"), words.alias("words"))
    return quality.low_confidence(rows, 0.5)


@query
def translate_fake(spark, d):
    return translation.translate(_keyed(spark, d), translation.Prefixing("zh"), 3)


@query
def translate_resume(spark, d):
    rows = _keyed(spark, d)
    done = rows.where("idx % 2 = 0").withColumn("text", F.concat(F.lit("[kept] "), "text"))
    return translation.translate(rows, translation.Prefixing("zh"), 3, done)


@query
def translation_fingerprint(spark, d):
    return translation.fingerprint(_keyed(spark, d), "model", "zh")


# Artifacts


@query
def artifact_versions_numbered(spark, d):
    return _versions(spark, d).select("artifact_id", "version", "name", "content")


@query
def artifact_current(spark, d):
    return artifacts.current(_versions(spark, d)).select("artifact_id", "version", "type", "name", "workflow_id", "content")


@query
def artifact_list_filtered(spark, d):
    return artifacts.listed(artifacts.current(_versions(spark, d)), workflow_id=7, step="step1", kind="F").select("artifact_id", "version", "name")


@query
def artifact_latest_by_name(spark, d):
    return artifacts.latest_by_name(artifacts.current(_versions(spark, d))).select("type", "name", "workflow_id", "artifact_id", "version")


@query
def artifact_append(spark, d):
    rows = _versions(spark, d)
    known = rows.where("content % 3 > 0").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("version"))
    new = rows.where("content % 3 = 0").groupBy("artifact_id", "created_at", "content").agg(F.count(F.lit(1)).alias("n"))
    return artifacts.appended(new, known).select("artifact_id", "version", "content", "content_hash", "content_size")


@query
def artifact_preview(spark, d):
    shown, cut = artifacts.preview(F.col("text"), 301)
    return table(spark, d, "documents").select("doc_id", shown.alias("preview"), F.coalesce(cut, F.lit(False)).alias("truncated"))


@query
def artifact_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("content_size"))


@query
def config_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.fingerprint(version=F.lit(1), workflow_id=F.col("p_type"), workflow=F.col("p_name"), plugin_paths=F.lit("")).alias("hash"))


@query
def cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", hashing.fingerprint(kind=F.lit("remote_url"), url=F.col("url"), quality=F.lit("best")).alias("cache_key"))


@query
def lineage_bindings(spark, d):
    return artifacts.bindings(_versions(spark, d))


@query
def artifact_reuse_map(spark, d):
    rows = artifacts.latest(_versions(spark, d).select("workflow_id", "name", "created_at", "artifact_id", "version"), ["workflow_id", "name"], ["created_at", "artifact_id", "version"])
    return rows.select("workflow_id", "name", "artifact_id")


# Events


@query
def events_sequenced(spark, d):
    return _log(spark, d).select("workflow_id", "sequence", "event_id")


@query
def events_appended(spark, d):
    log = _log(spark, d)
    return events.appended(log.where("sequence > 40").drop("sequence"), log.where("sequence <= 40")).select("workflow_id", "sequence", "event_id")


@query
def events_after(spark, d):
    return events.after(_log(spark, d), 40, 7).select("workflow_id", "sequence", "type")


@query
def events_latest_sequence(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id"))
    return events.latest_sequence(_log(spark, d), customers)


@query
def events_sse(spark, d):
    return events.sse(_log(spark, d))


def _status(spark: SparkSession, d: str) -> DataFrame:
    return events.step_status(_log(spark, d), _workflows(spark, d), 6, completed="purchase", failed="error", started="view")


@query
def monitor_step_status(spark, d):
    return _status(spark, d)


@query
def monitor_counts(spark, d):
    return events.status_counts(_status(spark, d))


@query
def monitor_latest_progress(spark, d):
    return events.latest_progress(events.progress_rows(_log(spark, d), "click"))


@query
def monitor_log_rows(spark, d):
    return events.log_rows(_log(spark, d), "click")


@query
def progress_throttled(spark, d):
    return events.throttled(events.progress_rows(_log(spark, d), "click"), 10.0)


@query
def download_bytes(spark, d):
    rows = _log(spark, d).select(F.col("workflow_id").alias("key"), F.col("step").alias("bar"), F.col("sequence").alias("at"), F.floor("percent").cast("long").alias("bytes"))
    return events.byte_totals(rows)


# Runs and tasks


@query
def active_runs(spark, d):
    return runs.active(_runs(spark, d)).select("run_id", "workflow_id", "status")


@query
def runs_ordered(spark, d):
    return runs.ordered(_runs(spark, d))


@query
def task_reuse(spark, d):
    wanted = _tasks(spark, d).where("run_id % 5 = 0")
    return runs.reusable(_tasks(spark, d), _runs(spark, d).where("run_id % 3 > 0"), wanted)


@query
def task_sync(spark, d):
    return runs.synced(_tasks(spark, d), _runs(spark, d).where("run_id % 3 > 0"))


@query
def workflow_state(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id"))
    return runs.effective(customers, _workflows(spark, d).select("workflow_id", F.col("run_status").alias("status")))


# Review


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _translated(spark, d)
    source = rows.where("idx % 4 < 3").select("key", "idx", "start_ms", "end_ms", F.col("source_text").alias("text"))
    late = F.when(F.col("key") % 9 == 0, 1_000_000).otherwise(100)
    return source, rows.where("idx % 3 < 2").select("key", "idx", (F.col("start_ms") + late).alias("start_ms"), "end_ms", "source_text", F.when(F.col("key") % 2 == 0, "").otherwise(F.col("text")).alias("text"))


@query
def review_segments(spark, d):
    return review.aligned(*_sides(spark, d))


@query
def review_duration(spark, d):
    return review.duration(review.aligned(*_sides(spark, d)))


@query
def segment_at_time(spark, d):
    rows = _segments(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("idx"), F.col("start_ms") + 200, (F.col("end_ms") + F.when(F.col("turn") % 3 == 0, 4000).otherwise(0)).alias("end_ms")).toDF("key", "idx", "start_ms", "end_ms")
    times = rows.groupBy("key").agg(F.max("end_ms").alias("last")).select("key", F.explode(F.expr("sequence(0L, last + 3000L, 1500L)")).alias("t"))
    return review.at_time(rows, times)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return review.bar_levels(rows.select((F.col("vec_id") * 64 + F.col("pos")).alias("frame"), F.col("value").cast("double").alias("value")), 240)


@query
def waveform_rms(spark, d):
    return _bars(spark, d)


@query
def waveform_pool(spark, d):
    return review.pooled(_bars(spark, d), 8).select("bar", F.bround("level", 6).alias("level"))


@query
def waveform_bar_count(spark, d):
    return _segments(spark, d).groupBy("conv_id").agg(F.max("end_ms").alias("ms")).select("conv_id", timecode.bar_count(F.col("ms")).alias("bars"))


@query
def percent_clamp(spark, d):
    return table(spark, d, "events").select("event_id", timecode.clamped_percent(F.col("value")).alias("percent"), F.bround(timecode.percent_of(F.col("value"), F.col("event_id") % 200), 6).alias("share"))


# Catalogue


@query
def youtube_host_filter(spark, d):
    return table(spark, d, "pages").select("page_id", catalog.is_host(F.col("url"), ("example.com", "example.net")).alias("known"))


@query
def format_options(spark, d):
    part = table(spark, d, "part")
    whole = lambda c: F.col(c).cast("int")
    label = catalog.format_label(
        F.col("p_name"), F.substring("p_brand", 7, 2), F.when(F.col("p_partkey") % 3 > 0, whole("p_size") * 16), F.when(F.col("p_partkey") % 5 > 0, whole("p_size") * 9),
        F.when(F.col("p_partkey") % 2 > 0, F.lit(30)), F.col("p_partkey") % 2 == 0, F.floor(F.col("p_retailprice") * F.col("p_partkey")),
    )
    presets = spark.sql("SELECT * FROM VALUES ('best', 0L, 'Best'), ('small ring', 1L, 'Preset') AS t(value, place, label)")
    rows = part.select(F.col("p_name").alias("value"), F.col("p_partkey").alias("place"), label.alias("label"))
    return catalog.first_wins([presets, rows], ["value"], ["place"])


@query
def union_dedup_first_wins(spark, d):
    names = lambda t, p: table(spark, d, t).select(F.lower(F.regexp_replace(f"{p}_name", "^[A-Za-z]+#0*", "")).alias("name"), F.col(f"{p}_{ {'c': 'cust', 's': 'supp'}[p]}key").alias("place"))
    return catalog.first_wins([names("supplier", "s"), names("customer", "c")], ["name"], ["place"]).select("name", F.col("part").cast("long").alias("part"), "place")


@query
def runs_last_wins(spark, d):
    return catalog.last_wins(_runs(spark, d).select("workflow_id", F.coalesce("started_at", F.lit("1970-01-01").cast("timestamp")).alias("started_at"), "run_id", "status"), ["workflow_id"], ["started_at", "run_id"]).select("workflow_id", "run_id", "status")


@query
def model_sizes(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_partkey") != 77, F.col("p_size").cast("long")).alias("size"))
    return catalog.complete_size(rows)


@query
def redact_messages(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", text.redacted(F.col("text"), SECRETS).alias("text"))


@query
def request_parameters(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.when(F.col("raw").rlike(r"^-?\d+(\.\d+)?$"), F.col("raw").try_cast("double")).alias("number"))


@query
def unified_diff(spark, d):
    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = _conversations(spark, d).withColumn("before", F.lag("text").over(turn)).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", catalog.unified_diff("before", "text").alias("diff"))
