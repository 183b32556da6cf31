"""Helpers that the operators of this subpackage share: shared-folder tables and Arrow views."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step looks at, whatever the size of the Arrow batch (one document may exceed it).
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        path = tempfile.mkdtemp(prefix="cueframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_name() -> str:
    return uuid.uuid4().hex


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{fresh_name()}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: So many rows of a few numbers each are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def bounded(rows: DataFrame, side: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the narrow table ``side``, which is written, counted, and broadcast only if it is small."""
    side = materialize(side, name)
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side.hint("shuffle_hash"), key, how)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or it with a number, so that no column in ``taken`` has it (Spark ignores case)."""
    low, k, out = {c.lower() for c in taken}, 0, name
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in the one column of ``ids``."""
    name = free_name("c_gone", docs.columns)
    ids = materialize(ids.toDF(name).distinct(), "gone")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(side, docs["doc_id"].cast("long") == ids[name], "left_anti")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets, without a copy; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, past) whose bytes stay near ``limit``; a longer row stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(past, n)
        first = min(past, n)


def release() -> None:
    """Gives freed memory back to the system at a task's end: workers live on from stage to stage, many to an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
