"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents gives one run: a bucketed table, sorted by key, of ``key, n_docs, last_doc, fresh``.  A batch is merge-anti-joined with the fresh keys
of the runs before it: keys that no run has go to the new run as fresh, the others as what the batch adds to them.  When a level holds ``fanout`` runs they
are compacted into one of the next level.  So each key is fresh in one run, and a key is common if its fresh row and what was added to it say so.
``LineRuns.save`` writes which runs there are, and ``LineRuns.opened`` goes on with them in a later job, so documents may arrive over time.

Defined cases: a null or empty text is one empty line; rows that share a ``doc_id`` count as documents of their own, and
each of them that holds the largest id keeps its lines; a null ``doc_id`` never counts as a document and its lines stay; an empty table gives an
empty table; columns other than ``doc_id`` and ``text`` are ignored by the operator and passed through by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm.common import bounded, free_name, fresh_name, fresh_path, materialize, remove, utf8

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
_BLANK = b" \t\n\x0b\x0c\r"


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A key for each line; None for lines too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_BLANK)
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.lower()))
    return out


def _line_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            ids, data, at = batch.column(0).to_pylist(), memoryview(raw), at.tolist()
            docs: list[int] = []
            keys: list[bytes] = []
            for row, doc in enumerate(ids):
                if doc is None:
                    continue
                own = set(_keys(bytes(data[at[row] : at[row + 1]]), min_chars))
                own.discard(None)
                keys.extend(own)
                docs.extend([doc] * len(own))
                if len(keys) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])
                    docs, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, key``: each document's distinct keys."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_line_batches(min_chars), "doc_id long, key binary")


RUN_COLUMNS = "key binary, n_docs long, last_doc long, fresh boolean"


class LineRuns:
    """Levelled sorted runs in the shared folder; level k holds at most ``fanout - 1`` runs between calls."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_runs_{fresh_name()}"
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.made = 0

    def save(self, path: str) -> None:
        """Writes which runs there are, one row each."""
        rows = [(level, name, self.paths[name], self.fanout, self.buckets) for level, names in enumerate(self.levels) for name in names]
        self.spark.createDataFrame(rows, "level int, name string, path string, fanout int, buckets int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs of a job before this one; their tables are declared anew where the catalog does not know them."""
        rows = sorted(spark.read.parquet(path).collect())
        out = cls(spark, *((rows[0].fanout, rows[0].buckets) if rows else ()))
        for r in rows:
            if not spark.catalog.tableExists(r.name):
                spark.sql(f"CREATE TABLE {r.name} ({RUN_COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {r.buckets} BUCKETS LOCATION '{r.path}'")
            out.levels += [[] for _ in range(r.level + 1 - len(out.levels))]
            out.levels[r.level].append(r.name)
            out.paths[r.name] = r.path
        return out

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        self.paths[name] = fresh_path(self.spark, name)
        writer = rows.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd")
        writer.option("path", self.paths[name]).saveAsTable(name)
        return name

    def _rows(self, name: str) -> DataFrame:
        """A run read as plain files: a union of bucketed scans would count as dealt by key without being so."""
        return self.spark.read.schema(RUN_COLUMNS).parquet(self.paths[name])

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Adds one batch of ``doc_id, key`` rows."""
        batch = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = [F.lit(False)]
        for k, name in enumerate(self.runs()):
            batch = batch.join(self.spark.table(name).where("fresh").select("key", F.lit(True).alias(f"in_{k}")), "key", "left")
            known.append(F.col(f"in_{k}"))
        self._place(0, self._write(batch.select("key", "n_docs", "last_doc", (~F.coalesce(*known[1:], known[0])).alias("fresh"))))

    def _place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merge(old))
            self._drop(old)
            self._place(level + 1, merged)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, self.paths.pop(name))

    def drop(self) -> None:
        """Deletes all runs."""
        self._drop(self.runs())
        self.levels = []

    def _merge(self, names: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self._rows(name) for name in names])
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.max("fresh").alias("fresh"))

    def common(self, min_docs: int) -> DataFrame:
        """``key, last_doc`` of keys in at least ``min_docs`` documents."""
        names = self.runs()
        more = reduce(DataFrame.unionByName, [self._rows(name).where("NOT fresh") for name in names])
        more = more.groupBy("key").agg(F.sum("n_docs").alias("more_docs"), F.max("last_doc").alias("later_doc"))
        total = F.col("n_docs") + F.coalesce("more_docs", F.lit(0))
        found = [self.spark.table(name).where("fresh").join(more, "key", "left").where(total >= min_docs) for name in names]
        return reduce(DataFrame.unionByName, [rows.select("key", F.greatest("last_doc", "later_doc").alias("last_doc")) for rows in found])


def _rewrite(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(0))
            data, at, drops = memoryview(raw), at.tolist(), batch.column(1).to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for row, drop in enumerate(drops):
                text = bytes(data[at[row] : at[row + 1]])
                gone = 0
                total = text.count(b"\n") + 1
                if drop:
                    drop = set(drop)
                    lines = [line for line, key in zip(text.split(b"\n"), _keys(text, min_chars), strict=True) if key is None or key not in drop]
                    gone, text = total - len(lines), b"\n".join(lines)
                n_lines.append(total)
                n_dropped.append(gone)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            cols = [batch.column(i) for i in range(2, batch.num_columns)]
            names = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*names, *RESULT])

    return run


#: What the rewriting adds, behind the columns that pass through; callers rename it, so these may clash with nothing.
RESULT = ("lines", "dropped", "kept")


def _drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """``doc, keys``: the keys whose lines a document loses.  What was written on the way is deleted."""
    spark = docs.sparkSession
    lines = line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = fresh_path(spark, "lines")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("doc_id", "key"))
    common = materialize(runs.common(min_docs), "common-lines")
    runs.drop()
    # A frequent line's rows stay where they are if the common keys are few; else Spark's adaptive joins split its partition.
    gone = bounded(lines.select("doc_id", "key"), common, "key", "common").where(F.col("doc_id") != F.col("last_doc"))
    out = materialize(gone.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list("key").alias("keys")), "dropped-lines")
    remove(spark, path)
    return out


def _deduped(docs: DataFrame, keep: list[str], digest: bool, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """The ``keep`` columns, in order, then ``lines, dropped, kept`` (digest or text)."""
    drops = _drops(docs, min_chars, min_docs, batches, fanout)
    # Names of no input column, so that none clash.
    inner = [f"c{k}" for k in range(len(keep))]
    left = docs.select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)])
    joined = left.join(drops.hint("shuffle_hash"), F.col("of") == F.col("doc"), "left").select("text", "keys", *inner)
    fields = "".join(f"{n} {left.schema[n].dataType.simpleString()}, " for n in inner)
    out = joined.mapInArrow(_rewrite(min_chars, digest), f"{fields}lines long, dropped long, kept string")
    return out.toDF(*keep, *[free_name(c, docs.columns) for c in RESULT])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; the other columns pass through, and texts without drops stay as they are (null: empty)."""
    out = _deduped(docs, [c for c in docs.columns if c != "text"], False, min_chars, min_docs, batches, fanout)
    return out.select(*[F.col(out.columns[-1]).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _deduped(docs, ["doc_id"], True, MIN_CHARS, MIN_DOCS, BATCHES, FANOUT)
    return out.toDF("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) s) t
), c AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.i, l.line, (c.k IS NOT NULL AND l.doc_id <> c.last_doc) AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
