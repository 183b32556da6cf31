"""Files as rows, written and read: ``name, content``.

Writing: consecutive rows of one name are one file, in their order, so a file of any size is written as it comes.  The Data Source ``cueframe_files`` lets each task attempt write into its own
staging folder below the target; its commit on the driver notes which attempts counted, one line each.  Tasks then check the names of all attempts against each other and move each attempt's
files to their places, so no name passes the driver.  A task or job that fails before the moves leaves no file; a move that is tried again goes on with what is left.
``mode("overwrite")`` removes the folder's earlier files after the moves; ``append`` replaces files of the same name.  A name that is no relative path, or stands twice, ends the job.

Reading: ``name, size, content`` of the visible files, listed by tasks (``store.listing``) and dealt to tasks by size.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cueframe.sources.store import batches, checked, dealt, listing, opened

FORMAT = "cueframe_files"
#: Bytes of the contents of one batch that is read.
BATCH_BYTES = 4 << 20
COUNTED = "counted.json"


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt's files wait, and how many they are."""

    folder: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, staging: str) -> None:
        self.path, self.staging = path, staging
        opened(path)[0].create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, _ = opened(self.path)
        task = TaskContext.get()
        folder = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        # Not recursive: once the job is aborted the staging folder is gone, and a task that lives on must not make it anew.
        files.create_dir(folder, recursive=False)
        stream, now, done, folders = None, None, set(), {folder}
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if name != now or stream is None:
                        if stream is not None:
                            stream.close()
                        if checked(name) in done:
                            raise ValueError(f"rows of {name!r} are not together")
                        done.add(name)
                        now, place = name, f"{folder}/{name}"
                        above = place.rsplit("/", 1)[0]
                        if above not in folders:
                            files.create_dir(above, recursive=True)
                            folders.add(above)
                        stream = files.open_output_stream(place)
                    if content.is_valid:
                        stream.write(content.as_buffer())
        except BaseException:
            if stream is not None:
                stream.close()
            _delete(files, folder)
            raise
        if stream is not None:
            stream.close()
        return Staged(folder, len(done))

    def commit(self, messages: list[Staged | None]) -> None:
        counted = [(m.folder, m.files) for m in messages if m is not None and m.files]
        with opened(self.path)[0].open_output_stream(f"{self.staging}/{COUNTED}") as out:
            out.write(json.dumps(counted).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        _delete(opened(self.path)[0], self.staging)


def _delete(files: fs.FileSystem, folder: str) -> None:
    """Deletes a folder in which a task that is being stopped may still be writing."""
    for _ in range(5):
        if files.get_file_info(folder).type != fs.FileType.Directory:
            return
        with contextlib.suppress(OSError):
            files.delete_dir(folder)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [("name", "string"), ("content", "binary")]:
            raise ValueError("name string, content binary are written")
        return FilesWriter(self.options["path"], self.options["staging"])


_NAMES = pa.schema([("name", pa.string())])
_PLACED = pa.schema([("files", pa.int64())])


def _staged(files: fs.FileSystem, folder: str) -> list[str]:
    """The names of an attempt's files that still wait."""
    return [f.path[len(folder) + 1 :] for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)) if f.is_file]


def _written(spark: SparkSession, path: str, staging: str) -> tuple[DataFrame, DataFrame]:
    """The attempts that counted, and the names of their files."""
    with opened(path)[0].open_input_stream(f"{staging}/{COUNTED}") as stream:
        counted = json.loads(stream.read())
    attempts = spark.createDataFrame(counted, "folder string, files long").repartition(max(1, len(counted)))

    def names(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        for batch in found:
            for folder, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                staged = _staged(files, folder)
                if len(staged) != count:
                    raise RuntimeError(f"{folder} holds {len(staged)} files of {count}")
                yield from batches(((name,) for name in staged), _NAMES)

    return attempts, attempts.mapInArrow(names, "name string")


def _placed(spark: SparkSession, path: str, staging: str, overwrite: bool) -> None:
    """Checks the names of the attempts that counted, and moves their files to their places."""
    old = listing(spark, path) if overwrite else None
    attempts, written = _written(spark, path, staging)

    def moves(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        for batch in found:
            for folder in batch.column(0).to_pylist():
                staged = _staged(files, folder)
                for above in {name.rsplit("/", 1)[0] for name in staged if "/" in name}:
                    files.create_dir(f"{root}/{above}", recursive=True)
                for name in staged:
                    try:
                        files.move(f"{folder}/{name}", f"{root}/{name}")
                    except FileNotFoundError:  # another attempt of this task has moved it
                        if not files.get_file_info(f"{root}/{name}").is_file:
                            raise
                _delete(files, folder)
                yield pa.RecordBatch.from_arrays([pa.array([len(staged)], pa.int64())], schema=_PLACED)

    def removed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        for batch in found:
            for place in batch.column(0).to_pylist():
                if files.get_file_info(place).is_file:
                    files.delete_file(place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], schema=_PLACED)

    twice = written.groupBy("name").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"two tasks wrote {twice.name!r}")
    if old is not None:
        # What goes is settled before the moves, as the staging folders are empty after them.
        gone = old.join(written, "name", "left_anti").select("path", "size")
        kept = f"{staging}/_gone"
        gone.write.parquet(kept)
    attempts.mapInArrow(moves, "files long").agg(F.sum("files")).first()
    if old is not None:
        dealt(spark.read.schema("path string, size long").parquet(kept)).mapInArrow(removed, "files long").agg(F.sum("files")).first()


def write_files(rows: DataFrame, path: str, mode: str = "append", noted: str | None = None) -> None:
    """``name, content`` (text or bytes) as files below ``path``; their names, as a table ``name``, in the new folder ``noted``."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"no mode: {mode}")
    spark = rows.sparkSession
    spark.dataSource.register(FilesSource)
    files, root = opened(path)
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    try:
        rows.selectExpr("CAST(name AS STRING) AS name", "CAST(content AS BINARY) AS content").write.format(FORMAT).option("staging", staging).mode("append").save(path)
        if noted is not None:
            _written(spark, path, staging)[1].write.parquet(noted)
        _placed(spark, path, staging, mode == "overwrite")
    finally:
        _delete(files, staging)


_READ = pa.schema([("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, content`` of the files below ``path``."""

    def contents(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        for batch in found:
            rows, held = [], 0
            for name, place, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with files.open_input_stream(place) as stream:
                    rows.append((name, size, stream.read()))
                held += size
                if held >= BATCH_BYTES:
                    yield from batches(iter(rows), _READ)
                    rows, held = [], 0
            yield from batches(iter(rows), _READ)

    return dealt(listing(spark, path)).mapInArrow(contents, "name string, size long, content binary")
