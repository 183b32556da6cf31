"""Read models of runs, tasks, workflows and reviews: lookups, synchronised records, first matches, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.text import redacted
from cueframe.operators.events import latest_sequence
from cueframe.operators.runs import TERMINAL


def lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per wanted key: the record, and whether there is one.  Many lookups are one join."""
    return wanted.select(*keys).distinct().join(rows.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def newest_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("updated_at"), F.desc("run_id"))


def run_sync(runs: DataFrame, states: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Runs with their workflow's ``state`` (pending where none is stored), its last event's sequence, and, where the state is final, the time of completion."""
    stored = states.select("workflow_id", F.col("status").alias("c_stored"))
    rows = runs.join(stored, "workflow_id", "left").withColumn("c_state", F.coalesce("c_stored", F.lit("pending"))).join(latest_sequence(log), "workflow_id", "left")
    return rows.select("run_id", "workflow_id", F.col("c_state").alias("status"), F.when(F.col("c_state").isin(*TERMINAL), now).alias("completed_at"), F.coalesce("latest", F.lit(0)).alias("latest_event_sequence"))


def failed(runs: DataFrame, log: DataFrame, now: Column, code: Column, message: Column) -> DataFrame:
    """Runs marked as failed, with the error and their workflow's last sequence."""
    rows = runs.join(latest_sequence(log), "workflow_id", "left")
    return rows.select("run_id", F.lit("failed").alias("status"), now.alias("completed_at"), F.coalesce("latest", F.lit(0)).alias("latest_event_sequence"), code.alias("error_code"), message.alias("error_message"))


def recorded(jobs: DataFrame, tasks: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Task records of jobs ``run_id, source_uri``: a known task keeps its id and time of creation; the state is its run's, or queued."""
    known = tasks.select("run_id", F.col("task_id").alias("c_id"), F.col("created_at").alias("c_created"))
    rows = jobs.join(known, "run_id", "left").join(runs.select("run_id", "status"), "run_id", "left")
    made = F.concat(F.lit("task_"), F.col("run_id").cast("string"))
    return rows.select("run_id", F.coalesce("c_id", made).alias("task_id"), "source_uri", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("c_created", now).alias("created_at"), now.alias("updated_at"))


def task_summary(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.col("run_id").alias("id"), F.coalesce("source_summary", "source_uri").alias("title"), "status")


def workflow_summary(workflows: DataFrame, steps: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """``workflow_id, steps, state, latest``: its steps in order, the stored state or pending, the last sequence."""
    listed = steps.groupBy("workflow_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "step_id"))), lambda s: s["step_id"]), ",").alias("steps"))
    rows = workflows.select("workflow_id").distinct().join(listed, "workflow_id", "left").join(states.select("workflow_id", "status"), "workflow_id", "left").join(latest_sequence(log), "workflow_id", "left")
    return rows.select("workflow_id", F.coalesce("steps", F.lit("")).alias("steps"), F.coalesce("status", F.lit("pending")).alias("state"), F.coalesce("latest", F.lit(0)).alias("latest"))


def projects(rows: DataFrame, workflows: DataFrame) -> DataFrame:
    """``project_id, name, workflow_count``."""
    count = workflows.groupBy("project_id").agg(F.countDistinct("workflow_id").alias("workflow_count"))
    return rows.select("project_id", "name").join(count, "project_id", "left").fillna(0, ["workflow_count"])


def first_project(wanted: DataFrame, runs: DataFrame, projects: DataFrame) -> DataFrame:
    """For each wanted run the first project (by ``place``) that holds it; runs ``project_id, run_id``."""
    rows = wanted.select("run_id").distinct().join(runs, "run_id").join(projects.select("project_id", "place"), "project_id")
    return rows.groupBy("run_id").agg(F.min_by("project_id", F.struct("place", "project_id")).alias("project_id"))


def role(kind: Column, name: Column) -> Column:
    """What an artifact is for a review: its roles, parted by commas."""
    both, low = F.lower(F.concat_ws(" ", kind, name)), F.lower(name)
    tests = {
        "segment": both.contains("segment") | both.contains("translation") | both.contains("subtitle"),
        "source": kind.isin("subtitle_segments", "asr_transcript"),
        "translation": (kind == "translation") | low.contains("translate."),
        "subtitle": kind == "subtitle",
        "video": kind == "video",
        "audio": kind == "audio",
    }
    return F.concat_ws(",", *[F.when(test, r) for r, test in tests.items()])


def first_preview(artifacts: DataFrame, previews: DataFrame, wanted: str) -> DataFrame:
    """For each workflow the first artifact (``workflow_id, place, kind, name, version_id``) of the role whose preview (``version_id, content, truncated``) is whole."""
    rows = artifacts.where(F.array_contains(F.split(role(F.col("kind"), F.col("name")), ","), wanted)).join(previews.where("NOT truncated"), "version_id")
    return rows.groupBy("workflow_id").agg(F.min(F.struct("place", "version_id", "content")).alias("x")).select("workflow_id", "x.version_id", "x.content")


def remote_title(tasks: DataFrame, videos: DataFrame) -> DataFrame:
    """For each task ``run_id, workflow_id, source_uri`` the stripped title of its workflow's first video (``workflow_id, place, url, title``) with that url, or
    with none, and a title that is not blank; a task whose ``source_uri`` is empty takes videos of any url.

    The first of each url, of those without, and of all are found before tasks come to them, so no task meets more than two rows.
    """
    title, at = F.trim("title"), F.col("place").isNotNull()
    first = videos.where(title != "").groupBy("workflow_id", "url").agg(F.min(F.when(at, F.struct("place", title.alias("title")))).alias("x"))
    kind = F.when(F.col("url").isNull(), "none").otherwise("url")
    found = first.select("workflow_id", kind.alias("kind"), F.coalesce("url", F.lit("")).alias("url"), "x")
    found = found.unionByName(first.groupBy("workflow_id").agg(F.min("x").alias("x")).select("workflow_id", F.lit("any").alias("kind"), F.lit("").alias("url"), "x"))
    key = lambda k, url: F.struct(F.lit(k).alias("kind"), url.alias("url"))
    keys = F.when(F.col("source_uri") == "", F.array(key("any", F.lit("")))).otherwise(F.array(key("url", F.col("source_uri")), key("none", F.lit(""))))
    rows = tasks.select("run_id", "workflow_id", F.explode(keys).alias("k")).select("run_id", "workflow_id", "k.*").join(found, ["workflow_id", "kind", "url"])
    return rows.groupBy("run_id").agg(F.min("x").alias("x")).select("run_id", F.col("x.title").alias("title"))


def bound_tools(tools: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tools' inputs ``tool, input, kinds, required`` bound to the last step output (``step_place, place, step_id, name, kind``) of a fitting kind: of several
    outputs of a step the first.  A tool with a required input that nothing fits has no binding at all."""
    kinds = tools.withColumn("kind", F.explode_outer(F.array_distinct("kinds")))
    fits = kinds.join(outputs, "kind", "left")
    last = fits.groupBy("tool", "input", "required").agg(F.max_by(F.concat("step_id", F.lit("."), "name"), F.when(F.col("step_place").isNotNull(), F.struct("step_place", -F.col("place")))).alias("binding"))
    broken = last.where("required AND binding IS NULL").select("tool").distinct()
    return last.where("binding IS NOT NULL").join(broken, "tool", "left_anti").select("tool", "input", "binding")


def save_status(segments: DataFrame) -> DataFrame:
    """``key, status``: an error anywhere, else something being saved, else saved."""
    any_ = lambda s: F.max(F.col("saved") == s)
    return segments.groupBy("key").agg(F.when(any_("error"), "Autosave error").when(any_("saving"), "Saving").otherwise("Saved").alias("status"))


def complete(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``key, complete``: whether all required names are among the key's."""
    return files.groupBy("key").agg((F.count_distinct(F.when(F.col("name").isin(*required), F.col("name"))) == len(required)).alias("complete"))


def artifact_counts(bindings: DataFrame) -> DataFrame:
    return bindings.groupBy("workflow_id").agg(F.count_distinct("name").alias("artifact_count"))


def tool_catalog(tools: DataFrame) -> DataFrame:
    """Tools with outputs, by reference."""
    return tools.where("outputs > 0").orderBy("ref")


def reordered(steps: DataFrame, order: DataFrame) -> DataFrame:
    """Steps ``workflow_id, step_id, place``: those listed in ``order`` (``step_id, wanted``) first, the rest as they were; ``at`` from 0."""
    rows = steps.join(order, "step_id", "left")
    by = Window.partitionBy("workflow_id").orderBy(F.col("wanted").asc_nulls_last(), "place")
    return rows.select("workflow_id", "step_id", (F.row_number().over(by) - 1).cast("long").alias("at"))


def default_first(models: DataFrame, default: Column) -> DataFrame:
    """``model, place`` -> with ``at``: the default before all others."""
    rows = models.withColumn("c_rank", F.when(F.col("model") == default, -1).otherwise(F.col("place")))
    return rows.select("provider", "model", (F.row_number().over(Window.partitionBy("provider").orderBy("c_rank")) - 1).cast("long").alias("at"))


def extra_steps(steps: DataFrame, base: DataFrame) -> DataFrame:
    """Steps that are enabled and not among the kind's base steps (``kind, step_id``)."""
    return steps.where("enabled").join(base, ["kind", "step_id"], "left_anti")


def normalized_progress(steps: DataFrame) -> DataFrame:
    """Steps ``workflow_id, step, status, task_status`` as they are shown: a failed step of a task that has not failed follows the task."""
    task, status = F.col("task_status"), F.col("status")
    shown = (
        F.when(task == "failed", status).when((status != "failed") & (task == "completed") & (status == "blocked"), "done").when(status != "failed", status)
        .when(task == "running", "running").when(task == "completed", "done").otherwise("blocked")
    )
    return steps.withColumn("shown", shown)


def step_summary(steps: DataFrame) -> DataFrame:
    """``workflow_id, summary`` of :func:`normalized_progress`: the first failed or running step, or the last one done."""
    first = lambda s: F.min(F.when(F.col("shown") == s, F.col("step")))
    rows = steps.groupBy("workflow_id", "task_status").agg(
        first("failed").alias("failed"), first("running").alias("running"), F.max(F.when(F.col("shown") == "done", F.col("step"))).alias("done"),
        F.max(F.col("status").isin("failed", "blocked")).alias("unfinished"),
    )
    name = lambda c: F.concat(F.lit("step "), F.col(c).cast("string"))
    task = F.col("task_status")
    text = (
        F.when(task == "failed", F.coalesce(F.concat(name("failed"), F.lit(" failed")), F.lit("Task failed")))
        .when(task == "running", F.coalesce(F.concat(name("running"), F.lit(" running")), F.lit("Task running")))
        .when(task == "completed", F.coalesce(F.when(~F.col("unfinished"), F.concat(name("done"), F.lit(" completed"))), F.lit("Task completed")))
        .when(task == "paused", "Task paused").when(task == "aborted", "Task aborted").when(task == "queued", "Waiting to start").otherwise("No active step")
    )
    return rows.select("workflow_id", text.alias("summary"))


def plugin_events(new: DataFrame, secrets: tuple[str, ...]) -> DataFrame:
    """Messages of plugins as ``plugin.event`` rows without secrets."""
    return new.select("workflow_id", "ts", "event_id", F.lit("plugin.event").alias("type"), redacted(F.col("message"), secrets).alias("message"))


def segment_progress(t: Column, first: Column, last: Column) -> Column:
    """How far ``t`` is in a segment, from 0 to 1; its ends may be in either order."""
    low, length = F.least(first, last), F.greatest(F.lit(1), F.abs(last - first))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - low) / length))


# The levels of a waveform that stands for none.
LEVELS = (24, 40, 62, 48, 72, 56, 80, 34)


def placeholder_bars(rows: DataFrame, count: Column) -> DataFrame:
    """``key, bar, level`` of ``count`` bars for each key."""
    bars = rows.select("key", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("bar"))
    return bars.select("key", F.col("bar").cast("long").alias("bar"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.pmod("bar", F.lit(len(LEVELS))).cast("int") + 1).cast("long").alias("level"))


def visible_bars(views: DataFrame, stride: int, buffer: int, margin: int = 18) -> DataFrame:
    """Views ``key, left, width, total_px, bars`` -> ``key, first, past``: which bars are drawn."""
    begin = F.greatest(F.lit(0), F.col("left") - margin - buffer)
    end = F.least(F.col("total_px"), F.col("left") + F.col("width") - margin + buffer)
    first, past = F.floor(begin / stride), F.least(F.col("bars"), F.ceil(end / stride))
    return views.select("key", first.cast("long").alias("first"), F.greatest(first, past).cast("long").alias("past"))


def retries(error: Column, url_is_video_host: Column, anonymous: Column, more: Column, markers: tuple[str, ...]) -> Column:
    """Whether a failed download tries its next way: never the last or an anonymous one; always for the host, else for errors that hold a marker."""
    hit = reduce(lambda a, m: a | F.lower(error).contains(m), markers, F.lit(False))
    return F.coalesce(more & ~anonymous & (url_is_video_host | hit), F.lit(False))


def hotwords(words: Column) -> Column:
    """Stripped words joined by commas; null for none."""
    said = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    return F.when(F.size(said) > 0, F.array_join(said, ", "))


def step_line(source: Column, output: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("input")), F.lit(" -> "), F.coalesce(F.replace(output, F.lit("_"), F.lit(" ")), F.lit("output")))


def tool_title(plugin: Column, tool: Column) -> Column:
    """A tool's name in title case; the tool ``qa`` is named after its plugin."""
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.when(tool == "qa", F.concat(title(plugin), F.lit(" QA"))).otherwise(title(tool))


def progress_seconds(line: Column) -> Column:
    """Seconds of a ``key=value`` progress line: microseconds under either of two keys, or a clock; null for other lines."""
    from cueframe.functions.timecode import clock_seconds

    key, value = F.substring_index(F.trim(line), "=", 1), F.regexp_extract(F.trim(line), "^[^=]*=(.*)$", 1)
    number = value.try_cast("long")
    micro = F.when(number.isNotNull(), F.greatest(number / 1_000_000, F.lit(0.0)))
    return F.when(key.isin("out_time_ms", "out_time_us"), micro).when(key == "out_time", clock_seconds(value))


def short_time(stamp: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of an ISO time, else the text itself."""
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    found = F.concat_ws(" ", F.regexp_extract(F.trim(stamp), form, 1), F.regexp_extract(F.trim(stamp), form, 2))
    return F.when(F.trim(stamp).rlike(form), found).otherwise(stamp)


def probed_seconds(output: Column) -> Column:
    """The duration that a probe printed; null if it printed no number."""
    return F.trim(F.regexp_replace(output, "\n", "")).try_cast("double")
