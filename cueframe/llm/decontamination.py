"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are lower-cased and their white space runs become one space; positions and edits count the characters (code points) of that form.
An item of n characters is found in a document when some part of the document is within ``e = floor(rate * n)`` edits of the
whole item.  Such a part shares at least ``n + 1 - q * (1 + e)`` q-grams with the item on e + 1 neighbouring
diagonals, so within one of the bands ``[k (e + 1), (k + 2) (e + 1))``; bands with fewer shared q-grams are dropped, the others are aligned.
e is lowered where the bound would fall under 1.  Only whole items are found: half an item in a document is no hit.

The benchmark is the query set: it is taken in blocks of about ``BLOCK_BYTES``, each broadcast once and held against all documents.  Shared q-grams are counted in
slices of at most ``PAIRS`` pairs of places, so texts and items that repeat one q-gram need time, not memory.

Defined cases: null and empty texts match nothing; items shorter than q match nothing; equal items and equal documents each
give their own rows; null ids stay null; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import release, without_ids

Q, RATE = 10, 0.08
#: Text bytes of one block of items, which every worker holds with about 20 bytes of index a text byte.
BLOCK_BYTES = 4 << 20
PAIRS = 1 << 19
#: Characters of documents that are taken together.
SLICE_CHARS = 1 << 18
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters (q from 8 to 16) from each place on: of its first and its last eight, mixed."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    h, base = data.astype(np.uint64) + np.uint64(1), 0xA24BAED4963EE407
    for width in (1, 2, 4):
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
    h ^= h >> np.uint64(31)
    return (h[: len(h) - (q - 8)] * _MIX) ^ (h[q - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F))


def _summed(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, into = np.unique(keys, return_inverse=True)
    return keys, np.bincount(into, weights=sizes, minlength=len(keys)).astype(np.int64)


class Index:
    """The items' q-grams: a bit table that rules most positions out, then sorted hashes with their postings."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE) -> None:
        self.q = q
        self.ids: list[int] = []
        self.texts: list[str] = []
        edits, bounds, hashes, owner, place = [], [], [], [], []
        for item_id, text in items:
            data = normal(text)
            if (n := len(data)) < q:
                continue
            e = min(int(rate * n), (n - q) // q)
            h = grams(codes(data), q)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(item_id)
            self.texts.append(data)
            edits.append(e)
            bounds.append(n + 1 - q * (1 + e))
        self.edits, self.bounds = np.array(edits, np.int64), np.array(bounds, np.int64)
        #: How many bands before a text's first an item's q-grams can lie in.
        self.reach = np.array([len(t) // (e + 1) + 2 for t, e in zip(self.texts, edits, strict=True)], np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int32)
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.past = np.append(self.first[1:], len(h))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, band) of the bands that meet the bound; ``starts``: where each row's text begins, rows being parted by a 0."""
        if not len(self.hashes) or len(data) < self.q:
            return []
        items, keys, sizes = len(self.ids), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Bands may begin before a text does.
        low, span = int(self.reach.max()), int(len(data) + 2 * self.reach.max()) + 2
        for begin in range(0, len(data), SLICE_CHARS):
            h = grams(data[begin : begin + SLICE_CHARS + self.q - 1], self.q)
            at = np.flatnonzero(self.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            found = np.searchsorted(self.hashes, h[at])
            found[found == len(self.hashes)] = 0
            same = self.hashes[found] == h[at]
            at, found = at[same] + begin, found[same]
            total = np.concatenate([[0], np.cumsum(self.past[found] - self.first[found])])
            for pair in range(0, int(total[-1]), PAIRS):
                which = np.arange(pair, min(pair + PAIRS, int(total[-1])))
                own = np.searchsorted(total, which, "right") - 1
                into = self.first[found[own]] + which - total[own]
                place, item = at[own], self.owner[into].astype(np.int64)
                row = np.searchsorted(starts, place, "right") - 1
                band = (place - starts[row] - self.place[into]) // (self.edits[item] + 1) + low
                key = (row * items + item) * span + band
                key, size = np.unique(np.concatenate([key, key - 1]), return_counts=True)
                keys, sizes = np.concatenate([keys, key]), np.concatenate([sizes, size])
                if len(keys) > 2 * PAIRS:
                    keys, sizes = _summed(keys, sizes)
        keys, sizes = _summed(keys, sizes)
        item = keys // span % items
        good = sizes >= self.bounds[item]
        keys, item = keys[good], item[good]
        return list(zip((keys // span // items).tolist(), item.tolist(), (keys % span - low).tolist(), strict=True))

    def align(self, text: str, item: int, band: int) -> tuple[int, int] | None:
        """(edits, end) of the item's best place on the band's diagonals, if within its budget."""
        pattern, e = self.texts[item], int(self.edits[item])
        low, high = band * (e + 1) - e, (band + 2) * (e + 1) - 1 + e
        if (k := text.find(pattern, max(0, low), max(0, high + len(pattern)))) >= 0:
            return 0, k + len(pattern)
        width, n = high - low + 1, len(pattern)
        padded = np.zeros(width + n, np.uint32)
        a, b = max(0, low), min(len(text), high + n)
        if a >= b:
            return None
        padded[a - low : b - low] = codes(text[a:b])
        valid = np.zeros(width + n + 1, bool)
        valid[max(0, -low) : max(0, len(text) - low) + 1] = True
        far, lane = 1 << 14, np.arange(width)
        row = np.where(valid[:width], 0, far)
        for i, char in enumerate(codes(pattern)):
            up = np.append(row[1:], far) + 1
            row = np.minimum(row + (padded[i : i + width] != char), up)
            row = np.where(valid[i + 1 : i + 1 + width], row, far)
            row = np.minimum.accumulate(row - lane) + lane
            if int(row.min()) > e:
                return None
        best = int(row.min())
        return best, low + n + int(row.argmin())


HIT_COLUMNS = "doc_id long, item_id long, edits int, end_at int"


def _hit_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            docs = batch.column(0)
            out: dict[tuple[int, int], tuple[int, int]] = {}
            texts: list[str] = []
            first = size = 0

            def flush(texts: list[str], first: int, out=out) -> None:
                starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
                for row, item, band in index.regions(codes("\0".join(texts)), starts):
                    if (hit := index.align(texts[row], item, band)) and hit < out.get((first + row, item), (1 << 30, 0)):
                        out[first + row, item] = hit

            for k in range(batch.num_rows):
                texts.append(normal(batch.column(1)[k].as_py()))
                size += len(texts[-1])
                if size >= SLICE_CHARS:
                    flush(texts, first)
                    first, texts, size = k + 1, [], 0
            if texts:
                flush(texts, first)
            keys = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array([k for k, _ in keys], pa.int64())), pa.array([index.ids[i] for _, i in keys], pa.int64()), pa.array([out[k][0] for k in keys], pa.int32()), pa.array([out[k][1] for k in keys], pa.int32())],
                ["doc_id", "item_id", "edits", "end_at"],
            )
        release()

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, edits, end_at``: one row for each document and item found in it, with its best place's edits and end."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(r.item_id, r.text) for r in block.toLocalIterator()], q, rate)
        hits = rows.mapInArrow(_hit_batches(docs.sparkSession.sparkContext.broadcast(index)), HIT_COLUMNS)
        out = hits if out is None else out.unionByName(hits)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found; ``docs``'s own columns."""
    return without_ids(docs, leaks(docs, benchmark, q, rate).select("doc_id"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
