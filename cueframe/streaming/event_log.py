"""A live event log as files, and its tail as a stream.

The log is a folder of segments ``workflow=<id>/<first>-<last>.jsonl``, whose names tell their sequences.  Each append ends by adding its segments to the log's index, a table of
``workflow_id, first, last, name`` in which a workflow's segments of one append stand in one file.  A tail of all workflows is Spark's file stream of that index; tasks read the segments, so neither
the driver nor an offset holds workflows or segments.  A tail of one workflow is the streaming Data Source ``cueframe_events``, which lists its folder; its offset is the last
sequence (``{"7": 120}``).  A query that is started again goes on after its offset.

A workflow's events are handed on up to the first gap; what comes after it waits (for all workflows, in a state of segments), unless the reader waits itself (``wait=False``).
Options of the Data Source: ``path``, ``workflow`` (one id), ``afterSequence`` (where a new query begins).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cueframe.operators.events import sse
from cueframe.sources.files import write_files
from cueframe.sources.store import batches, listed, listing, opened, shared_folder

FORMAT = "cueframe_events"
COLUMNS = "workflow_id long, sequence long, type string, step int, percent double, event_id long"
FIELDS = [c.split()[0] for c in COLUMNS.split(", ")]
_SEGMENT = r"workflow=(-?\d+)/(\d+)-(\d+)\.jsonl$"
_NAME = re.compile(_SEGMENT)
_EVENTS = pa.schema([("workflow_id", pa.int64()), ("sequence", pa.int64()), ("type", pa.string()), ("step", pa.int32()), ("percent", pa.float64()), ("event_id", pa.int64())])
#: The folder of the index in the log; readers of files do not see it.
INDEX, INDEXED = "_segments", "workflow_id long, first long, last long, name string"
#: Segment files that one task reads.
TASK_FILES = 500


def append_log(events: DataFrame, path: str, size: int = 1000) -> None:
    """Numbered events (``COLUMNS``) as segments of at most ``size`` events; a row for each event, in order."""
    part = Window.partitionBy("workflow_id", "c_part")
    rows = events.select(*FIELDS).withColumn("c_part", F.floor((F.col("sequence") - 1) / size))
    ends = F.concat(F.min("sequence").over(part).cast("string"), F.lit("-"), F.max("sequence").over(part).cast("string"))
    rows = rows.withColumn("name", F.concat(F.lit("workflow="), F.col("workflow_id").cast("string"), F.lit("/"), ends, F.lit(".jsonl")))
    rows = rows.sortWithinPartitions("workflow_id", "c_part", "sequence")
    spark, (files, root) = events.sparkSession, opened(path)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        _indexed(spark, path)
    noted = shared_folder(spark, "segments")
    write_files(rows.select("name", F.concat(F.to_json(F.struct(*FIELDS)), F.lit("\n")).alias("content")), path, noted=noted)
    _index(spark.read.schema("name string").parquet(noted), path)


def _index(names: DataFrame, path: str) -> None:
    # A workflow's segments in one file, so that a tail sees all of them or none.
    part = lambda k: F.regexp_extract("name", _SEGMENT, k).cast("long")
    rows = names.where(F.col("name").rlike(_SEGMENT)).select(part(1).alias("workflow_id"), part(2).alias("first"), part(3).alias("last"), "name")
    rows.repartition("workflow_id").write.mode("append").parquet(f"{path}/{INDEX}")


def _indexed(spark: SparkSession, path: str) -> None:
    """Makes the index of a log that has none: of one that is not there yet, or was written without."""
    files, root = opened(path)
    if not files.get_file_info(f"{root}/{INDEX}/_SUCCESS").is_file:
        there = files.get_file_info(root).type != fs.FileType.NotFound
        _index(listing(spark, path).select("name") if there else spark.createDataFrame([], "name string"), path)


@dataclass
class Segments(InputPartition):
    """Files, and of each the sequences after ``after`` up to ``through``."""

    files: list[tuple[str, int, int]]


def _read(line: bytes, after: int, through: int | None) -> tuple | None:
    event = json.loads(line)
    if event["sequence"] <= after or (through is not None and event["sequence"] > through):
        return None
    if isinstance(event.get("percent"), str):  # JSON has no number for NaN and infinities
        event["percent"] = float(event["percent"])
    return tuple(event.get(f) for f in FIELDS)


class TailReader(DataSourceStreamReader):
    """The segments are listed, and the offset has an entry for each workflow listed, so it suits one workflow or a few."""

    def __init__(self, path: str, workflow: int | None, after: int) -> None:
        self.path, self.workflow, self.after = path, workflow, after
        self.found: dict[int, list[tuple[int, int, str]]] | None = None

    def segments(self) -> dict[int, list[tuple[int, int, str]]]:
        """The segments of each workflow in order: first and last sequence, and place."""
        out = defaultdict(list)
        for f in listed(self.path):
            if (m := _NAME.search(f.path)) and (self.workflow is None or int(m[1]) == self.workflow):
                out[int(m[1])].append((int(m[2]), int(m[3]), f.path))
        return {w: sorted(found) for w, found in out.items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        self.found = self.segments()
        for workflow, found in self.found.items():
            at = self.after
            for first, last, _ in found:
                if first > at + 1:
                    break
                at = max(at, last)
            if at > self.after:
                out[str(workflow)] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Segments]:
        # The listing that gave the latest offset serves the batch up to it; a batch planned again after a restart lists anew.
        known, self.found, files = self.found if self.found is not None else self.segments(), None, []
        for workflow, found in known.items():
            after, through = start.get(str(workflow), self.after), end.get(str(workflow), self.after)
            files += [(path, after, through) for first, last, path in found if last > after and first <= through]
        return [Segments(files[k : k + TASK_FILES]) for k in range(0, len(files), TASK_FILES)] or [Segments([])]

    def read(self, partition: Segments) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for path, after, through in partition.files:
            with files.open_input_stream(path) as stream:
                for line in stream.read().splitlines():
                    if (event := _read(line, after, through)) is not None:
                        yield event


class EventsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema: StructType) -> TailReader:
        workflow = self.options.get("workflow")
        return TailReader(self.options["path"], None if workflow is None else int(workflow), int(self.options.get("afterSequence", 0)))


def tail(spark: SparkSession, path: str, workflow: int | None = None, after: int = 0, wait: bool = True) -> DataFrame:
    """The events of the log as a stream (``COLUMNS``).  ``wait``: what comes after a gap waits; without it, only for all workflows, events come as they were appended."""
    if workflow is not None:
        spark.dataSource.register(EventsSource)
        return spark.readStream.format(FORMAT).option("path", path).option("afterSequence", after).option("workflow", workflow).load()
    _indexed(spark, path)
    found = spark.readStream.schema(INDEXED).parquet(f"{path}/{INDEX}").where(F.col("last") > after)
    if wait:
        found = found.groupBy("workflow_id").applyInPandasWithState(_ready(after), "name string, after long, through long", _WAITING, "append", GroupStateTimeout.NoTimeout)
    else:
        found = found.repartition("workflow_id").select("name", F.lit(after).cast("long").alias("after"), F.lit(None).cast("long").alias("through"))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)

        def events() -> Iterator[tuple]:
            for batch in rows:
                for name, start, through in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    with files.open_input_stream(f"{root}/{name}") as stream:
                        for line in stream.read().splitlines():
                            if (event := _read(line, start, through)) is not None:
                                yield event

        return batches(events(), _EVENTS)

    return found.mapInArrow(read, COLUMNS)


_WAITING = "at long, firsts array<long>, lasts array<long>, names array<string>"


def _ready(after: int):
    """Of a workflow's segments those up to the first gap, with the sequences that are new in them; the others wait."""

    def ready(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, *waiting = state.get if state.exists else (after, [], [], [])
        rows = set(zip(*waiting, strict=True))
        for frame in frames:
            rows.update(zip(frame["first"].tolist(), frame["last"].tolist(), frame["name"].tolist(), strict=True))
        through = at
        for first, last, _ in sorted(rows):
            if first > through + 1:
                break
            through = max(through, last)
        now = sorted(r for r in rows if r[1] > at and r[0] <= through)
        yield pd.DataFrame({"name": [name for *_, name in now], "after": at, "through": through})
        held = sorted(r for r in rows if r[0] > through + 1)
        state.update((through, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))

    return ready


def write_sse(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Server-sent event text of the stream, a file for each workflow and micro-batch.  A batch that is run again writes the same names anew, so its events stand once.

    ``every``: the time between polls; without it the query ends when it has caught up.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.repartition("workflow_id").sortWithinPartitions("workflow_id", "sequence")
        name = F.concat(F.lit(f"batch={number:09d}/"), F.col("workflow_id").cast("string"), F.lit(".sse"))
        write_files(sse(rows).select(name.alias("name"), F.col("text").alias("content")), path)

    out = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
