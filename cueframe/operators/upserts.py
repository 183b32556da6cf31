"""Tables of records by key on files: an upsert reads and rewrites only the buckets that its changes touch.

A table is a folder.  ``rows/<batch>/c_bucket=<b>`` holds rows, ``snapshots/<n>.json`` names for each bucket the batch that holds its rows now, so readers see
whole states, also earlier ones; an upsert that fails leaves a batch that no snapshot names.  A snapshot holds one short entry a bucket, so choose buckets of a few
hundred megabytes.  One writer at a time.

Defined cases: keys may be null, and a null equals a null; of several changes of a key in one batch the last by ``order`` counts, ties go to the largest
values of the other columns; columns that the table has not are ignored; a batch without rows makes no snapshot; an empty table reads as no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cueframe.sources.store import listed, opened

BUCKET = "c_bucket"


@dataclass(frozen=True)
class Snapshot:
    number: int
    keys: list[str]
    buckets: int
    schema: str
    at: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _commit(path: str, now: Snapshot) -> Snapshot:
    files, root = opened(path)
    files.create_dir(f"{root}/snapshots", recursive=True)
    hidden = f"{root}/snapshots/_{uuid.uuid4().hex}"
    with files.open_output_stream(hidden) as out:
        out.write(json.dumps(asdict(now)).encode())
    files.move(hidden, f"{root}/snapshots/{now.number:010}.json")
    return now


def snapshot(path: str, number: int | None = None) -> Snapshot:
    """The last state of a table, or the state of that number."""
    found = listed(f"{path}/snapshots")
    if number is not None:
        found = [f for f in found if f.base_name == f"{number:010}.json"]
    if not found:
        raise ValueError(f"no such table or state: {path}")
    files, _ = opened(path)
    with files.open_input_stream(found[-1].path) as stream:
        return Snapshot(**json.loads(stream.read()))


def created(path: str, schema: StructType, keys: Sequence[str], buckets: int) -> Snapshot:
    """A table without rows."""
    if BUCKET in (c.lower() for c in schema.names):
        raise ValueError(f"{BUCKET} is the name of the folders")
    if lost := [k for k in keys if k not in schema.names]:
        raise ValueError(f"{lost[0]} is no column")
    return _commit(path, Snapshot(0, list(keys), buckets, schema.json()))


def _bucket(now: Snapshot) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast(now.columns[k].dataType) for k in now.keys]), F.lit(now.buckets)).cast("int")


def _rows(spark: SparkSession, path: str, now: Snapshot, only: Iterable[int] | None = None) -> DataFrame:
    held = sorted(map(int, now.at)) if only is None else [b for b in sorted(only) if str(b) in now.at]
    places = [f"{path}/rows/{now.at[str(b)]}/{BUCKET}={b}" for b in held]
    return spark.read.schema(now.columns).parquet(*places) if places else spark.createDataFrame([], now.columns)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """All rows of a state."""
    return _rows(spark, path, snapshot(path, number))


def lookup(wanted: DataFrame, path: str, number: int | None = None) -> DataFrame:
    """The rows whose keys are in ``wanted``; only the buckets of these keys are read."""
    now = snapshot(path, number)
    buckets = [r[0] for r in wanted.select(_bucket(now)).distinct().collect()]
    ids = wanted.select(*[F.col(k).alias(f"w_{i}") for i, k in enumerate(now.keys)])
    rows = _rows(wanted.sparkSession, path, now, buckets)
    same = [rows[k].eqNullSafe(ids[f"w_{i}"]) for i, k in enumerate(now.keys)]
    return rows.join(ids, same, "left_semi")


def upsert(changes: DataFrame, path: str, order: Sequence[str], keep: Sequence[str] = ()) -> Snapshot:
    """The state after ``changes``: of each key the last change by ``order`` replaces the row there is, but for the columns ``keep``, which stay as they first were."""
    spark, now = changes.sparkSession, snapshot(path)
    names, batch = now.columns.names, uuid.uuid4().hex
    typed = changes.select(*[F.col(c).cast(now.columns[c].dataType).alias(c) for c in names])
    # Tasks reduce their own rows first, so a key with most of the changes costs one row a task.
    firsts = [F.min(F.struct(*order, *keep)).alias("c_first")] if keep else []
    last = typed.groupBy(*now.keys).agg(F.max(F.struct(*order, *[c for c in names if c not in order])).alias("c_last"), *firsts)
    last = last.select(*[F.col(f"{'c_first' if c in keep else 'c_last'}.{c}").alias(c) for c in names])
    staged = f"{path}/changes/{batch}"
    last.withColumn(BUCKET, _bucket(now)).write.partitionBy(BUCKET).parquet(staged)
    new = spark.read.schema(StructType([*now.columns.fields, StructField(BUCKET, IntegerType())])).parquet(staged)
    # One number a bucket at most.
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
    if not touched:
        return now
    new = new.select(*[F.col(c).alias(f"n_{i}") for i, c in enumerate(names)], F.lit(True).alias("n_there"))
    old = _rows(spark, path, now, touched).select(*[F.col(c).alias(f"o_{i}") for i, c in enumerate(names)], F.lit(True).alias("o_there"))
    place = {c: i for i, c in enumerate(names)}
    both = old.join(new, [old[f"o_{place[k]}"].eqNullSafe(new[f"n_{place[k]}"]) for k in now.keys], "full_outer")
    merged = both.select(
        *[F.when(F.col("o_there"), F.col(f"o_{i}")).otherwise(F.col(f"n_{i}")).alias(c) if c in keep else F.when(F.col("n_there"), F.col(f"n_{i}")).otherwise(F.col(f"o_{i}")).alias(c) for c, i in place.items()]
    )
    dealt = merged.withColumn(BUCKET, _bucket(now)).repartition(BUCKET).sortWithinPartitions(BUCKET, *now.keys)
    dealt.write.partitionBy(BUCKET).parquet(f"{path}/rows/{batch}")
    files, root = opened(path)
    files.delete_dir(f"{root}/changes/{batch}")
    return _commit(path, Snapshot(now.number + 1, now.keys, now.buckets, now.schema, now.at | {str(b): batch for b in touched}))
