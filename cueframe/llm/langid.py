"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte 2- and 3-grams; each language has a few clustered centroids (spherical k-means);
the language of the most similar centroid is predicted.  Texts farther from it than nearly all its own training texts are marked
``rejected`` (distance-based rejection); the prediction stays, as the query's contract knows no other value for a text with letters.

Document frequencies count all training rows; each language's clusters are fitted, in one task, on at most ``SAMPLE_ROWS`` of its rows, those of the least
hashed ids.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training row all texts are; rows with a null language train nothing; equal texts get
equal values; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import free_name, release, row_slices, utf8

BITS = 12
DIMS = 1 << BITS
CENTROIDS, ROUNDS = 4, 8
#: At most so many training rows a language (2 * DIMS bytes each) fit its clusters.
SAMPLE_ROWS = 1000
#: This share of a centroid's own training texts lies farther away than its rejection distance.
REJECT = 0.002
#: ASCII letters in lower case; other ASCII bytes count as blanks, so that digits, marks and layout say nothing.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, DIMS) counts of the hashed grams of each row's letters, runs of other characters being one blank; no gram crosses rows."""
    n = len(at) - 1
    x = _LETTERS[raw].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    said = (x != 32) | (np.r_[np.uint32(0), x[:-1]] != 32)
    x, row = x[said], row[said]
    out = np.zeros(n * DIMS, np.int64)
    gram = x
    for k in (1, 2):
        if len(x) <= k:
            break
        gram = gram[:-1] | (x[k:] << np.uint32(8 * k))
        cell = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        inside = row[:-k] == row[k:]
        cell += row[:-k] << BITS
        out += np.bincount(cell[inside], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    raw, at = utf8(batch.column(column))
    for first, past in row_slices(at, 1 << 20):
        for a in range(first, past, 256):
            b = min(a + 256, past)
            yield a, b, gram_counts(raw[at[a] : at[b]], at[a : b + 1] - at[a])


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, _, counts in _slices(batch, 0):
            total += (counts > 0).sum(axis=0)
            rows += len(counts)
    # Cell DIMS carries the number of rows.
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(total, rows))], ["cell", "n"])


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [c.tobytes() for _, _, counts in _slices(batch, 0) for c in np.minimum(counts, 65535).astype(np.uint16)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(vectors, pa.binary())], ["lang", "v"])


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray
    languages: list[str]
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = (np.sqrt(counts) * self.idf).astype(np.float32)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(norm, 1e-12)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; centers and each one's rejection similarity."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    centers = x[seeds]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sims = x @ centers.T
    own = sims.argmax(axis=1)
    radius = np.array([np.quantile(sims[own == j, j], REJECT) if (own == j).any() else 0.0 for j in range(len(centers))])
    return centers, radius


def _cluster_language(idf: np.ndarray, k: int):
    def run(table: pa.Table) -> pa.Table:
        raw = sorted(table["v"].to_pylist())
        x = Centroids(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0)).vectors(np.frombuffer(b"".join(raw), np.uint16).reshape(-1, DIMS))
        centers, radius = _clusters(x, k)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centers)), "center": pa.array([c.astype("<f4").tobytes() for c in centers], pa.binary()), "radius": pa.array(radius.astype(float))})

    return run


def fit(training: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Centroids:
    """Learns from the rows of ``training`` whose text and language are not null."""
    rows = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"))
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("text").mapInArrow(_df_batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[r.cell] = r.n
    total = df[DIMS]
    idf = np.log((1 + total) / (1 + df[:DIMS])) + 0.01
    # One small row per language, not per document.
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, 1.2 * sample_rows / n)).otherwise(share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).withColumn("place", place).where(F.col("place") <= sample_rows).select("text", "lang")
    vectors = chosen.mapInArrow(_vector_batches, "lang string, v binary")
    found = sorted(vectors.groupBy("lang").applyInArrow(_cluster_language(idf, centroids), "lang string, center binary, radius double").collect(), key=lambda r: (r.lang, bytes(r.center)))
    centers = np.frombuffer(b"".join(bytes(r.center) for r in found), "<f4").reshape(-1, DIMS)
    return Centroids(idf, centers, [r.lang for r in found], np.array([r.radius for r in found]))


def _predict_batches(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        und = len(model.languages)
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, und), np.zeros(n)
            if und:
                for a, b, counts in _slices(batch, 0):
                    sims = model.vectors(counts) @ model.centers.T
                    best[a:b] = sims.argmax(axis=1)
                    score[a:b] = sims.max(axis=1)
                raw, at = utf8(batch.column(0))
                data = memoryview(raw)
                for k in range(n):
                    text = bytes(data[at[k] : at[k + 1]])
                    if not _LETTER.search(text[:400].decode("utf-8", "ignore")) and not _LETTER.search(text.decode("utf-8", "ignore")):
                        best[k], score[k] = und, 0.0
            rejected = np.array([j < und and s < model.radius[j] for j, s in zip(best, score, strict=True)], bool)
            cols = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rejected)], [*batch.schema.names[1:], "lang_pred", "score", "rejected"]
            )
        release()

    return run


def predict(docs: DataFrame, model: Centroids, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, then ``lang_pred, score, rejected`` (or the next free names)."""
    inner = [f"c{k}" for k in range(len(keep))]
    rows = docs.select((F.col(text) if isinstance(text, str) else text).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)])
    fields = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in inner)
    out = rows.mapInArrow(_predict_batches(model), f"{fields}lang_pred string, score double, rejected boolean")
    return out.toDF(*keep, *[free_name(c, list(keep)) for c in ("lang_pred", "score", "rejected")])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
