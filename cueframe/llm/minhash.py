"""MinHash near-dedup with circulant signatures.

Two permutations make all signature coordinates: the first spreads a document's shingles over a circle of 2**32 places, the second, a bijection of 32-bit
numbers, gives each place its rank, and coordinate k is the least rank over the places shifted by k.  Coordinates are banded; documents that share a band's
bucket are candidates, and a link is confirmed on the full shingle sets.

Exact copies (equal sets) are one node.  Candidates are checked in steps that lose no pair of a bucket and never emit all pairs of a group:

1. Each member meets its bucket's smallest id, the pivot, after a comparison of signatures.  Components come from alternating large-star and small-star rounds.
2. Where a pivot's group of at most ``BLOCK`` members still holds several components, its members meet each other in one task, by matrix products of their
   shingles, and only links that join components come out.
3. The members of larger such groups are dealt anew, by their rarest shingles: of two similar documents, each has one of the other's shingles among its
   ``n - ceil(similarity * n) + 1`` rarest ones.  So documents of one template that share only what is frequent do not meet at all.  Where the first shingle
   that two documents share leaves ``r`` of the ``n`` shingles of each, they share at most the lesser ``r``, so they are similar only if ``n / r`` of both together is at most
   ``1 + 1 / similarity``.  So of a shingle's members, those over half of that bound (the late ones) never meet each other, and meet nobody where no early member is
   left.  Groups of the same members meet once.  Members meet as in step 2, in blocks bounded by members and shingles.

Defined cases: null texts and texts without a word have an empty set, are linked with nothing and kept; rows that share a ``doc_id`` are versions of
one document; rows without a ``doc_id`` are linked with nothing and have a null component; ties go to the smaller id; an empty
table gives an empty table; other columns pass through ``one_of_each``, whatever their names, and are else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import bounded, materialize, release, row_slices, utf8, without_ids

SHINGLE = 5
#: Similarity as a fraction.
SIMILAR = (80, 100)
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Candidates whose signatures agree on a smaller share of the coordinates are not read: at a true similarity of 0.8 that is over five
#: standard deviations off.
LEAST_AGREEMENT = 0.58
#: Members, and shingles, of one block of a group whose members meet each other.
BLOCK, BLOCK_SHINGLES = 512, 200_000
#: Text bytes that are hashed together.
SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int) -> np.ndarray:
    x = np.full(SLICE_BYTES, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


#: Powers of the base and of its inverse modulo 2**64.
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case), in order, and the row it is in."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    said = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    start = np.flatnonzero(said & (np.r_[True, ~said[:-1]] | first[:-1]))
    past = np.flatnonzero(said & (np.r_[~said[1:], True] | first[1:])) + 1
    h = np.empty(len(start), np.uint64)
    for begin in range(0, len(raw), SLICE_BYTES):
        end = min(begin + SLICE_BYTES, len(raw))
        a, b = np.searchsorted(start, (begin, end))
        value = _LOWER[raw[begin:end]].astype(np.uint64) + _U(1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(value * _UP[: end - begin], out=sums[1:])
        h[a:b] = (sums[np.minimum(past[a:b], end) - begin] - sums[start[a:b] - begin]) * _DOWN[start[a:b] - begin]
    # A word that goes on in later slices.
    for w in np.flatnonzero(start // SLICE_BYTES != (past - 1) // SLICE_BYTES).tolist():
        total, k, end = int(h[w]), (int(start[w]) // SLICE_BYTES + 1) * SLICE_BYTES, int(past[w])
        while k < end:
            part = _LOWER[raw[k : min(k + SLICE_BYTES, end)]].astype(np.uint64) + _U(1)
            total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k - int(start[w]), 1 << 64)
            k += SLICE_BYTES
        h[w] = total % (1 << 64)
    return mixed(h + (past - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)), np.searchsorted(at, start, "right") - 1


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's set of k-word shingles as sorted hashes; fewer words count as one shingle."""
    n = len(at) - 1
    h, row = word_hashes(raw, at)
    words = np.bincount(row, minlength=n)
    edge = np.concatenate([[0], np.cumsum(words)])
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s = s * _U(_BASE) + h[j : len(h) - k + 1 + j]
        s = mixed(s)
    out = []
    for r in range(n):
        if (w := int(words[r])) >= k:
            out.append(np.unique(s[edge[r] : edge[r + 1] - k + 1]))
        else:
            one = np.array([w], np.uint64)
            for x in h[edge[r] : edge[r + 1]]:
                one = one * _U(0xD6E8FEB86659FD93) + x
            out.append(mixed(one) if w else np.zeros(0, np.uint64))
    return out


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column's texts, a slice of them at a time."""
    raw, at = utf8(column)
    for first, past in row_slices(at, SLICE_BYTES):
        yield from shingle_sets(raw[at[first] : at[past]], at[first : past + 1] - at[first], k)


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of coordinates for each set; coordinate k is the least rank of the shingles' places shifted by k."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
    place = (np.concatenate([*sets, np.zeros(0, np.uint64)]) * _U(0xFF51AFD7ED558CCD) >> _U(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for first in range(0, len(place), 1024):
        x = place[first : first + 1024, None] + _SHIFTS
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
        own = owner[first : first + 1024]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        own = own[edge]
        out[own] = np.minimum(out[own], np.minimum.reduceat(x, edge, axis=0))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mixed(h * _U(_BASE) + x[:, j])
    return h.view(np.int64)


SKETCH_COLUMNS = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for first, past in row_slices(at, SLICE_BYTES):
                sets = shingle_sets(raw[at[first] : at[past]], at[first : past + 1] - at[first], k)
                sigs = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, past - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([bands(g) if len(s) else None for g, s in zip(sigs, sets, strict=True)], pa.list_(pa.int64())),
                        pa.array([(g & 255).astype(np.uint8).tobytes() if len(s) else None for g, s in zip(sigs, sets, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
                )
        release()

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough; columns a, b, sketch of a, sketch of b."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _confirmed(k: int, similar: tuple[int, int]):
    """Columns pivot, doc, text, a pivot's own row before its group's: the links of members whose full sets are similar to the pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sets = None, []
        for batch in batches:
            out = []
            for pivot, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_sets(batch.column(2), k), strict=True):
                if doc == pivot:
                    # A document may have versions.
                    own, sets = pivot, [*sets, x] if own == pivot else [x]
                elif any(_similar(x, y, similar) for y in sets):
                    out.append((pivot, doc))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    return run


def _similar(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and similar[1] * both >= similar[0] * (len(x) + len(y) - both)


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones, as products of 0/1 matrices over the shingles that several sets have."""
    value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    row, column = row[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += x[left] @ x[right].T
    return out


def _block_links(k: int, similar: tuple[int, int]):
    """Within one pair of blocks of a pivot's group (columns i, j, block, doc, comp, text): links that join its different components, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        block, doc, comp = (np.asarray(table[c]) for c in ("block", "doc", "comp"))
        sets = list(text_sets(table["text"], k))
        left, right = np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())
        size = np.array([len(s) for s in sets], np.int64)
        both = _shared_counts(sets, left, right).astype(np.int64)
        linked = similar[1] * both >= similar[0] * (size[left][:, None] + size[right][None, :] - both)
        linked &= (comp[left][:, None] != comp[right][None, :]) & (both > 0)
        a, b = np.nonzero(linked)
        parent = {c: c for c in np.unique(comp).tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                parent[p] = q
                out.append((min(int(doc[x]), int(doc[y])), max(int(doc[x]), int(doc[y]))))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """``doc, comp`` of every document in ``links`` (``a, b``): the least id it can reach."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # Stars now: every b has one a, its component.
    return edges.groupBy("b").agg(F.min("a").alias("comp")).select(F.col("b").alias("doc"), "comp")


def _texts_of(texts: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``texts`` (``doc_id, text``) whose id is in the one column of ``ids``, as ``doc, text``."""
    return bounded(texts.toDF("doc", "text"), ids.toDF("doc").distinct(), "doc", name, "left_semi")


def _links(pairs: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Confirms candidate pairs ``a, b`` on whole texts: each member is sent once to its pivot, and the pivot once to each part of its members."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    members = bounded(pairs, parts, "a", "parts-of").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc"))
    wanted = materialize(members.unionByName(own), "wanted")
    rows = wanted.join(_texts_of(texts, wanted.select("doc"), "wanted-texts"), "doc")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("doc") != F.col("a"))
    return rows.select("a", "doc", "text").mapInArrow(_confirmed(k, similar), "a long, b long")


def _meeting(groups: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Links that join different components ``comp`` within each group of ``pivot, doc, comp, block, meets``: a member meets the blocks below its ``meets``, and its own."""
    rows = materialize(groups, "rest")
    rows = rows.join(_texts_of(texts, rows.select("doc"), "rest-texts"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    rows = rows.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "comp", "text")
    return rows.groupBy("pivot", "i", "j").applyInArrow(_block_links(k, similar), "a long, b long")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc"), blocks).cast("int")


def _several(groups: DataFrame) -> DataFrame:
    """``pivot, m, size`` of the groups of ``pivot, doc, comp, n_shingles`` that hold more than one component."""
    return groups.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).where("m > 1 AND low <> high").select("pivot", "m", "size")


def _blocks(m: Column, size: Column) -> Column:
    return F.greatest(F.ceil(m / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _admissible(rare: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Of ``pivot, doc, comp, n_shingles, weight`` (``n / r``), the members that can be similar to another of their group, as ``pivot, doc, comp, block, meets``.

    Early members come first in the numbering of blocks and meet all; late ones meet the early ones alone.  Weights are compared with a little slack, which costs
    a meeting and loses no link.
    """
    most = 1 + similar[1] / similar[0] + 1e-9
    low = rare.groupBy("pivot").agg(F.min("weight").alias("w"), F.count(F.lit(1)).alias("c_n")).where(f"w <= {most / 2!r} AND c_n > 1").select("pivot", "w")
    left = bounded(rare, low, "pivot", "rare-low").where(F.col("weight") + F.col("w") <= most).withColumn("early", F.col("weight") <= most / 2)
    left = materialize(left.select("pivot", "doc", "comp", "n_shingles", "early"), "rare-left")
    number = F.xxhash64("doc", "early")
    sums = left.groupBy("pivot").agg(
        F.count_if("early").alias("m"), F.sum(F.when(F.col("early"), F.col("n_shingles")).otherwise(0)).alias("size"),
        F.count_if(~F.col("early")).alias("m_late"), F.sum(F.when(F.col("early"), 0).otherwise(F.col("n_shingles"))).alias("size_late"),
        F.min("comp").alias("least"), F.max("comp").alias("most"),
        F.sum(number.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(number)).alias("xor"),
    ).where("m + m_late > 1 AND least <> most")
    once = sums.groupBy("m", "size", "m_late", "size_late", "sum", "xor").agg(F.min("pivot").alias("pivot"))
    once = once.select("pivot", _blocks(F.col("m"), F.col("size")).alias("blocks"), _blocks(F.col("m_late"), F.col("size_late")).alias("late"))
    met = bounded(left, once, "pivot", "rare-several")
    block = F.when(F.col("early"), _dealt(F.col("blocks"))).otherwise(F.col("blocks") + _dealt(F.greatest(F.col("late"), F.lit(1))))
    return met.select("pivot", "doc", "comp", block.alias("block"), F.when(F.col("early"), F.col("blocks") + F.col("late")).otherwise(F.col("blocks")).alias("meets"))


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                sets = list(text_sets(part.column(1), k))
                keys = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["doc", "version", "shingles"])
        release()

    return run


def _by_rare_shingle(docs: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """``pivot, doc, comp, n_shingles, weight``: the documents ``doc, comp`` grouped by each of their rarest shingles; ``weight`` is all their shingles over those from it on."""
    sets = _texts_of(texts, docs.select("doc"), "large-texts").mapInArrow(_set_batches(k), "doc long, version long, shingles array<long>")
    said = materialize(sets, "large-sets").select("doc", "version", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("shingle"))
    often = said.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = said.join(often, "shingle").groupBy("doc", "version", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    n = F.col("n_shingles")
    ranked = ranked.select("doc", "n_shingles", F.slice("s", F.lit(1), (n - F.ceil(n * similar[0] / similar[1]) + 1).cast("int")).alias("s"))
    rare = ranked.select("doc", "n_shingles", F.posexplode("s").alias("pos", "s")).where("s.often > 1")
    rare = rare.select(F.col("s.shingle").alias("pivot"), "doc", "n_shingles", (n / (n - F.col("pos"))).alias("weight")).join(docs, "doc")
    # Versions of a document are one member.
    return rare.groupBy("pivot", "doc", "comp").agg(F.max("n_shingles").alias("n_shingles"), F.min("weight").alias("weight"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialize(texts.mapInArrow(_sketch_batches(shingle), SKETCH_COLUMNS), "sketches")
    reps = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "representatives")
    nodes = sets.join(reps.select(F.col("rep").alias("doc_id"), F.col("set_key").alias("own")), "doc_id").where("set_key = own").select("doc_id", "n_shingles", "bands", "sketch")
    nodes = materialize(nodes, "nodes")
    buckets = nodes.select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"))
    # The smallest id by an aggregate that each task reduces first, so no bucket is sorted or gathered.
    least = buckets.groupBy("band").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("band", "a")
    pivots = bounded(buckets, least, "band", "least").where("a <> doc").select("a", F.col("doc").alias("b")).distinct()
    pivots = materialize(pivots, "pivots")
    sketch = nodes.select(F.col("doc_id").alias("id"), "sketch")
    pairs = pivots.join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    pairs = materialize(pairs.select("a", "b", "x", "y").mapInArrow(_agreeing, "a long, b long").distinct(), "candidates")
    links = materialize(_links(pairs, texts, shingle, similar), "confirmed")
    comp = materialize(components(links), "components")

    # A bucket's members all met its pivot.  Where the pivot's group still holds several components, their members meet each other.
    group = pivots.select(F.col("a").alias("pivot"), F.col("b").alias("doc")).unionByName(pivots.select(F.col("a").alias("pivot"), F.col("a").alias("doc")).distinct())
    size = nodes.groupBy(F.col("doc_id").alias("doc")).agg(F.sum("n_shingles").alias("n_shingles"))
    placed = group.join(size, "doc").join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    placed = materialize(placed, "placed")
    rest = materialize(bounded(placed, _several(placed), "pivot", "several"), "unsettled").where("doc <> pivot")
    large = F.col("m").cast("long") > BLOCK
    blocks = _blocks(F.col("m"), F.col("size"))
    more = _meeting(rest.where(~large).select("pivot", "doc", "comp", _dealt(blocks).alias("block"), blocks.alias("meets")), texts, shingle, similar)
    far = materialize(rest.where(large).select("doc", "comp").distinct(), "large")
    if far.limit(1).count():
        rare = materialize(_by_rare_shingle(far, texts, shingle, similar), "rare")
        more = more.unionByName(_meeting(_admissible(rare, similar), texts, shingle, similar))
    more = materialize(more, "more")
    if more.limit(1).count():
        comp = components(links.unionByName(more))
    found = sets.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").join(comp, F.col("rep") == F.col("doc"), "left")
    comp_id = F.coalesce("comp", "rep", "doc_id")
    comp_id = F.when(F.col("doc_id").isNotNull(), comp_id)
    return found.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; its own columns."""
    return without_ids(docs, near_duplicates(docs, shingle, similar).where("NOT kept").select("doc_id"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
