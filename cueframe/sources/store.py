"""Folders that driver and tasks share, and the file system calls on them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that one task lists, files and bytes of one reading task, and rows of a batch of names.
TASK_FOLDERS, TASK_FILES, TASK_BYTES, NAMES = 2000, 2000, 64 << 20, 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.rstrip("/") or "/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; a temporary one only where all runs in this process (tests)."""
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.gettempdir()
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checked(name: str | None) -> str:
    """``name`` if it is a relative path below a folder, without parts that readers hide."""
    parts = (name or "").split("/")
    if not all(p and p not in (".", "..") and p[0] not in "_." and "\0" not in p for p in parts):
        raise ValueError(f"no name for a file: {name!r}")
    return name


def listed(path: str) -> list[fs.FileInfo]:
    """The visible files below a folder of few files, in order of name; none if it is not there.  ``path`` of each is in the file system."""
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    inside = lambda f: f.path[len(root) :].strip("/").split("/")
    return sorted((f for f in found if f.is_file and not any(p[:1] in ("_", ".") for p in inside(f))), key=lambda f: f.path)


LISTED = "name string, path string, size long"
_LISTED = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64())])


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = NAMES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``name, path, size`` of the visible files below a folder, listed by tasks level by level and written, so that no name passes the driver; no rows if the folder is not there."""
    root, place = opened(path)[1], shared_folder(spark, "listing")

    def below(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files of each folder, and its folders with null as size."""
        files, _ = opened(path)

        def entries() -> Iterator[tuple]:
            for batch in found:
                for folder in batch.column(0).to_pylist():
                    for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                        if f.base_name[:1] not in ("_", "."):
                            yield f.path[len(root) :].strip("/"), f.path, f.size if f.is_file else None

        return batches(entries(), _LISTED)

    folders, levels, count = spark.createDataFrame([(root,)], "path string"), [], 1
    while count:
        levels.append(f"{place}/{len(levels):03}")
        folders.repartition(-(-count // TASK_FOLDERS)).mapInArrow(below, LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(LISTED).parquet(levels[-1]).where("size IS NULL").select("path")
        count = folders.count()
    return spark.read.schema(LISTED).parquet(*levels).where("size IS NOT NULL")


def dealt(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows with a ``size`` dealt to tasks of about ``task_bytes`` or TASK_FILES rows, but to no more tasks of small files than keep all cores busy."""
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = max(-(-count // TASK_FILES), -(-size // max(task_bytes, TASK_BYTES)))
    return rows.repartition(max(1, least, min(-(-size // task_bytes), 4 * rows.sparkSession.sparkContext.defaultParallelism)))
