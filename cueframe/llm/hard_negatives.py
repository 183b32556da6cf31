"""Hard negatives by a dual-tree search.

A tree over all rows begins with planes fitted on a bounded sample; its regions are dealt out in blocks of bounded size, a region of many rows as several.  Each block's
task builds the rest of the tree over its rows, and a tree over each chunk of the anchors sent to it.  Pairs of nodes descend together: an interval of the inner products between two balls
prunes a pair, and with it a whole group of anchors, unless it can still reach a result of one of them; pairs of leaves are scored exactly.  The sample gives every
anchor a score that its results must reach, so regions out of reach get no copy of it, and a block starts with bounds.

Two searches are run: each anchor's positives, then, with their scores known, the negatives of each (anchor, positive) in its band.  Blocks give their best few; a window over these picks the
result.  All rows are candidates, and no pair of rows is shuffled.

Defined cases: rows without ``vec_id`` or label, or with a null vector or a component that is null or not finite, take no part; vectors of different lengths are filled up with 0; exact
repeats of a row count once, and rows that only share a ``vec_id`` are rows of their own, of which none is its namesake's positive or negative; an empty table has no result; other columns are ignored.  A score
beyond 64 bits counts as the nearest one of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import materialize, release

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Rows that the planes are fitted on and first bounds are taken from, about; regions at most.
SAMPLE, REGIONS = 4096, 64
#: Bytes of the vectors of one block as doubles, and rows of the least block that is worth a task.
BLOCK_BYTES, LEAST_BLOCK = 32 << 20, 2048
#: Anchors that a block's task searches together; rows of a leaf on either side; candidates that are scored together.
CHUNK, ANCHOR_LEAF, LEAF, STRIDE = 512, 32, 256, 4096
EXACT, TOP = float(2**53), np.iinfo(np.int64).max


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part; every seventh id has the next label."""
    x = F.col("embedding")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float("inf"), F.lit(False)))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = embeddings.where(vec_id.isNotNull() & label.isNotNull() & x.isNotNull()).where(fits)
    return rows.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), x.alias("vec"))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The whole numbers ``floor(256 x)`` of a column of vectors as doubles, filled up with 0."""
    sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, np.int64)
    flat = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * SCALE)
    if (sizes == dims).all():
        return flat.reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def distinct(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The places of the rows' first copies."""
    rows = np.ascontiguousarray(np.column_stack([ids.view(np.float64), labels.view(np.float64), vectors + 0.0]))
    return np.sort(np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True)[1])


# --- trees


def _axis(points: np.ndarray) -> np.ndarray:
    """The direction of the largest spread, by a few steps of power iteration from the farthest point."""
    inner = points - points.mean(0)
    axis = inner[np.argmax((inner * inner).sum(1))]
    for _ in range(4):
        size = np.linalg.norm(axis)
        if not size:
            break
        axis = inner.T @ (inner @ (axis / size))
    size = np.linalg.norm(axis)
    return axis / size if size else axis


@dataclass
class Planes:
    """The top of the tree: planes in heap order, each row goes left or right at one a level."""

    levels: int
    axes: np.ndarray
    at: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, levels: int) -> Planes:
        axes, at = np.zeros((2**levels - 1, points.shape[1])), np.zeros(2**levels - 1)
        parts = [points]
        for k in range(len(axes)):
            part = parts[k]
            if len(part) > 1:
                axes[k] = _axis(part)
                along = part @ axes[k]
                at[k] = np.median(along)
                parts += [part[along <= at[k]], part[along > at[k]]]
            else:
                parts += [part, part[:0]]
        return cls(levels, axes, at)

    def region(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        if self.levels:
            right = points @ self.axes.T > self.at
            for _ in range(self.levels):
                node = 2 * node + 1 + right[np.arange(len(points)), node]
        return node - (2**self.levels - 1)


@dataclass
class Tree:
    """Balls over rows: ``order`` puts each node's rows together, ``first`` to ``past``; a leaf has no children.  ``labels`` is a set of labels as bits (by label modulo 64)."""

    order: np.ndarray
    first: np.ndarray
    past: np.ndarray
    left: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    labels: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        order = np.argsort(labels, kind="stable")
        spans, left, k = [(0, len(points))], [], 0
        while k < len(spans):
            a, b = spans[k]
            if b - a > leaf:
                rows = order[a:b]
                if labels[rows[0]] != labels[rows[-1]]:
                    middle = int(np.searchsorted(labels[rows], labels[rows[(b - a) // 2]]))
                    middle = middle or int(np.searchsorted(labels[rows], labels[rows[0]], "right"))
                else:
                    order[a:b] = rows[np.argsort(points[rows] @ _axis(points[rows]), kind="stable")]
                    middle = (b - a) // 2
                left.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            else:
                left.append(-1)
            k += 1
        center, radius, bits = np.zeros((len(spans), points.shape[1])), np.zeros(len(spans)), np.zeros(len(spans), np.uint64)
        mask = np.uint64(1) << (labels % 64).astype(np.uint64)
        for k, (a, b) in enumerate(spans):
            rows = order[a:b]
            if len(rows):
                center[k] = points[rows].mean(0)
                radius[k] = np.sqrt(((points[rows] - center[k]) ** 2).sum(1).max())
                bits[k] = np.bitwise_or.reduce(mask[rows])
        spans = np.array(spans)
        return cls(order, spans[:, 0], spans[:, 1], np.array(left), center, radius, bits)


def intervals(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, rounded outwards, of the inner products between the rows of nodes ``i`` of one tree and ``j`` of the other."""
    middle = np.einsum("kd,kd->k", a.center[i], b.center[j])
    na, nb = np.sqrt((a.center[i] ** 2).sum(1)), np.sqrt((b.center[j] ** 2).sum(1))
    reach = na * b.radius[j] + nb * a.radius[i] + a.radius[i] * b.radius[j]
    reach += 1e-9 * (na * nb + reach) + 1
    return middle - reach, middle + reach


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exactly; beyond 64 bits the nearest of 64 bits."""
    if np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    out = [[max(-TOP, min(TOP, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole] for p in ([int(x) for x in row] for row in a.tolist())]
    return np.array(out, np.int64).reshape(len(a), len(b))


def best(points: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties by smaller id, in that order."""
    near = np.arange(len(points))
    if len(points) > 4 * k:
        near = np.flatnonzero(points >= np.partition(points, len(points) - k)[len(points) - k])
    return near[np.lexsort((ids[near], -points[near]))][:k]


@dataclass
class Wants:
    """What a chunk of anchors looks for, a row for each anchor and a column for each of its searches: the highest ``k`` scores from ``low`` to ``high`` of rows of
    the same label, or of others.  ``low`` rises as results come; ``found`` holds (score, id) of each."""

    same: bool
    k: int
    low: np.ndarray
    high: np.ndarray
    found: list[list[list[tuple[int, int]]]]

    @classmethod
    def make(cls, same: bool, k: int, low: np.ndarray, high: np.ndarray) -> Wants:
        return cls(same, k, low.copy(), high, [[[] for _ in row] for row in low])

    def take(self, anchor: int, points: np.ndarray, ids: np.ndarray) -> None:
        for q in range(self.low.shape[1]):
            fit = np.flatnonzero((points >= self.low[anchor, q]) & (points <= self.high[anchor, q]))
            if len(fit):
                had = self.found[anchor][q]
                s = np.concatenate([points[fit], np.array([x[0] for x in had], np.int64)])
                n = np.concatenate([ids[fit], np.array([x[1] for x in had], np.int64)])
                top = best(s, n, self.k)
                self.found[anchor][q] = list(zip(s[top].tolist(), n[top].tolist(), strict=True))
                if len(top) == self.k:
                    self.low[anchor, q] = s[top[-1]]


@dataclass
class Points:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def search(anchors: Points, near: Tree, rows: Points, tree: Tree, wants: Wants) -> int:
    """Fills ``wants`` from ``rows``; returns how many pairs of rows were scored."""
    scored = 0
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    least = lambda: np.array([wants.low[near.order[a:b]].min(initial=TOP) for a, b in zip(near.first, near.past, strict=True)], np.float64)
    low, high = least(), np.array([wants.high[near.order[a:b]].max(initial=-TOP) for a, b in zip(near.first, near.past, strict=True)], np.float64)
    while len(i):
        bottom, top = intervals(near, tree, i, j)
        live = (top >= low[i]) & (bottom <= high[i])
        if wants.same:
            live &= (near.labels[i] & tree.labels[j]) != 0
        i, j = i[live], j[live]
        ends_i, ends_j = near.left[i] < 0, tree.left[j] < 0
        both = ends_i & ends_j
        pairs.append((i[both], j[both]))
        i, j, ends_i, ends_j = i[~both], j[~both], ends_i[~both], ends_j[~both]
        di, dj = ~ends_i, ~ends_j
        after = [(np.where(di, near.left[i] + s, i), np.where(dj, tree.left[j] + t, j), (di | (s == 0)) & (dj | (t == 0))) for s in (0, 1) for t in (0, 1)]
        i, j = np.concatenate([x[ok] for x, _, ok in after]), np.concatenate([y[ok] for _, y, ok in after])
    i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    bottom, top = intervals(near, tree, i, j)
    for leaf in np.unique(i):
        group = near.order[near.first[leaf] : near.past[leaf]]
        mine = np.flatnonzero(i == leaf)
        mine = mine[np.argsort(-top[mine], kind="stable")]
        while len(mine):
            mine = mine[top[mine] >= wants.low[group].min()]
            sizes = np.cumsum(tree.past[j[mine]] - tree.first[j[mine]])
            n = max(1, int(np.searchsorted(sizes, STRIDE, "right"))) if len(mine) else 0
            if n:
                at = np.concatenate([tree.order[tree.first[x] : tree.past[x]] for x in j[mine[:n]]])
                points, scored = scores(anchors.vectors[group], rows.vectors[at]), scored + len(group) * len(at)
                for k, anchor in enumerate(group):
                    fit = (rows.labels[at] == anchors.labels[anchor]) == wants.same
                    fit &= rows.ids[at] != anchors.ids[anchor]
                    wants.take(int(anchor), points[k][fit], rows.ids[at[fit]])
            mine = mine[n:]
    return scored


# --- blocks


@dataclass
class Index:
    """The top of the tree: planes, each region's box, rows and blocks, and the sample."""

    dims: int
    planes: Planes
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    blocks: np.ndarray
    sample: Points

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        region = self.planes.region(vectors)
        return self.first[region] + _mixed(ids) % self.blocks[region]

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def reached(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which regions may hold a row whose product with an anchor lies from ``low`` to ``high``: anchors by regions."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        top, bottom = up @ self.high.T + down @ self.low.T, up @ self.low.T + down @ self.high.T
        slack = 1e-9 * (np.abs(vectors) @ np.maximum(np.abs(self.low), np.abs(self.high)).T) + 1
        return (top + slack >= low[:, None]) & (bottom - slack <= high[:, None]) & (self.count > 0)

    def bounds(self, anchors: Points, wants: Wants) -> None:
        """Raises ``wants.low`` to what rows of the sample already reach, then forgets those rows."""
        for a in range(0, len(anchors.ids), CHUNK):
            points = scores(anchors.vectors[a : a + CHUNK], self.sample.vectors)
            for k in range(len(points)):
                fit = ((self.sample.labels == anchors.labels[a + k]) == wants.same) & (self.sample.ids != anchors.ids[a + k])
                wants.take(a + k, points[k][fit], self.sample.ids[fit])
        wants.found = [[[] for _ in row] for row in wants.found]


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(3)).astype(np.int64)


def _points(batch: pa.RecordBatch, dims: int) -> Points:
    return Points(np.asarray(batch.column("vec_id")), np.asarray(batch.column("label")), matrix(batch.column("vec"), dims))


def fit(rows: DataFrame) -> Index | None:
    """The index of ``usable`` rows: counts, a sample of about SAMPLE rows, planes, and each region's box from all rows; None without rows."""
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return None
    dims = max(1, dims)
    share = min(1.0, SAMPLE / n)
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).limit(2 * SAMPLE).toArrow().combine_chunks().to_batches()
    sample = _points(some[0], dims) if some else Points(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims)))
    at = distinct(sample.ids, sample.labels, sample.vectors)
    sample = Points(sample.ids[at], sample.labels[at], sample.vectors[at])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = max(LEAST_BLOCK, BLOCK_BYTES // (8 * dims))
    size = min(most, max(LEAST_BLOCK, n // (4 * cores)))
    levels = min(int(np.log2(REGIONS)), max(0, int(np.log2(max(1, n / size))))) if len(sample.ids) > 1 else 0
    planes = Planes.fit(sample.vectors, levels)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((2**levels, dims), np.inf), np.full((2**levels, dims), -np.inf), np.zeros(2**levels, np.int64)
        for batch in batches:
            vectors = matrix(batch.column("vec"), dims)
            region = planes.region(vectors)
            np.minimum.at(low, region, vectors)
            np.maximum.at(high, region, vectors)
            count += np.bincount(region, minlength=2**levels)
        at = np.flatnonzero(count)
        place, dim = np.repeat(at, dims), np.tile(np.arange(dims), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(dim), pa.array(low[at].ravel()), pa.array(high[at].ravel()), pa.array(np.where(dim == 0, count[place], 0))], ["region", "dim", "low", "high", "n"])

    found = rows.select("vec").mapInArrow(boxes, "region long, dim long, low double, high double, n long").groupBy("region", "dim").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
    low, high, count = np.zeros((2**levels, dims)), np.zeros((2**levels, dims)), np.zeros(2**levels, np.int64)
    for region, dim, a, b, k in found:
        low[region, dim], high[region, dim] = a, b
        count[region] += k
    return Index(dims, planes, low, high, count, np.maximum(1, -(-count // size)), sample)


SENT = "block long, anchor boolean, key long, vec_id long, label long, vec {vec}, low array<long>, high array<long>"


def _sent(batch: pa.RecordBatch, at: np.ndarray, block: np.ndarray, anchor: bool, key: pa.Array, low: list | None = None, high: list | None = None) -> pa.RecordBatch:
    take = pa.array(at)
    none = pa.nulls(len(at), pa.list_(pa.int64()))
    columns = [pa.array(block, pa.int64()), pa.array(np.full(len(at), anchor)), key, batch.column("vec_id").take(take), batch.column("label").take(take), batch.column("vec").take(take)]
    columns += [pa.array(low, pa.list_(pa.int64())) if anchor else none, pa.array(high, pa.list_(pa.int64())) if anchor else none]
    return pa.RecordBatch.from_arrays(columns, ["block", "anchor", "key", "vec_id", "label", "vec", "low", "high"])


def _candidates(rows: DataFrame, index: Index, form: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _points(batch, index.dims)
            at = distinct(p.ids, p.labels, p.vectors)
            yield _sent(batch, at, index.block(p.ids[at], p.vectors[at]), False, pa.nulls(len(at), pa.int64()))

    return rows.mapInArrow(run, form)


def _anchors(anchors: DataFrame, index: Index, form: str, same: bool, k: int) -> DataFrame:
    """Each anchor ``key, vec_id, label, vec, low, high`` once for each block that it may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), CHUNK):
                batch = whole.slice(a, CHUNK)
                low, high = (_limits(batch.column(c)) for c in ("low", "high"))
                p = _points(batch, index.dims)
                wants = Wants.make(same, k, low, high)
                index.bounds(p, wants)
                at, region = np.nonzero(index.reached(p.vectors, wants.low.min(1).astype(np.float64), high.max(1).astype(np.float64)))
                n = index.blocks[region]
                at, block = np.repeat(at, n), np.repeat(index.first[region], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for b in range(0, len(at), 4 * CHUNK):
                    part = at[b : b + 4 * CHUNK]
                    yield _sent(batch, part, block[b : b + 4 * CHUNK], True, batch.column("key").take(pa.array(part)), wants.low[part].tolist(), high[part].tolist())

    return anchors.select("key", "vec_id", "label", "vec", "low", "high").mapInArrow(run, form)


def _limits(column: pa.Array) -> np.ndarray:
    """Limits as a table; an anchor with fewer searches than others repeats its last one."""
    rows = column.to_pylist()
    width = max(map(len, rows), default=1)
    return np.array([r + [r[-1]] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)


FOUND = "key long, anchor_id long, search int, vec_id long, score long"


def _search_blocks(index: Index, same: bool, k: int):
    """Sorted rows of blocks, candidates first -> the best of each anchor's searches in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, rows, tree = None, [], None, None
        for batch in batches:
            block, anchor = np.asarray(batch.column("block")), np.asarray(batch.column("anchor").to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, kept, rows, tree = block[a], [], None, None
                part = batch.slice(a, b - a)
                if not anchor[a]:
                    kept.append(_points(part, index.dims))
                    continue
                if not kept:
                    continue
                if rows is None:
                    rows = Points(*(np.concatenate([getattr(x, f) for x in kept]) for f in ("ids", "labels", "vectors")))
                    at = distinct(rows.ids, rows.labels, rows.vectors)
                    rows = Points(rows.ids[at], rows.labels[at], rows.vectors[at])
                    tree = Tree.build(rows.vectors, rows.labels, LEAF)
                for c in range(0, len(part), CHUNK):
                    chunk = part.slice(c, CHUNK)
                    p, low, high = _points(chunk, index.dims), _limits(chunk.column("low")), _limits(chunk.column("high"))
                    wants = Wants.make(same, k, low, high)
                    search(p, Tree.build(p.vectors, p.labels, ANCHOR_LEAF), rows, tree, wants)
                    widths = [len(x) for x in chunk.column("low").to_pylist()]
                    keys = chunk.column("key").to_pylist()
                    out = [(keys[x], int(p.ids[x]), q, n, s) for x in range(len(keys)) for q in range(widths[x]) for s, n in wants.found[x][q]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "anchor_id", "search", "vec_id", "score"])
        release()

    return run


def _searched(rows: DataFrame, anchors: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """``FOUND``, with ``rank``: the results of all searches of ``anchors`` over ``rows``."""
    form = SENT.format(vec=rows.schema["vec"].dataType.simpleString())
    sent = _candidates(rows, index, form).unionAll(_anchors(anchors, index, form, same, k))
    blocks = sent.repartition(int(index.blocks.sum()), "block").sortWithinPartitions("block", "anchor")
    order = Window.partitionBy("key", "search").orderBy(F.desc("score"), "vec_id")
    return blocks.mapInArrow(_search_blocks(index, same, k), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows for which ``is_anchor`` holds (over ``vec_id`` and ``label``)."""
    rows = usable(embeddings)
    spark, index = embeddings.sparkSession, fit(rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor).distinct()
    every = F.array(F.lit(-TOP)), F.array(F.lit(TOP))
    anchors = materialize(chosen.select(F.xxhash64("vec_id", "label", "vec").alias("key"), "vec_id", "label", "vec"), "anchors")
    found = _searched(rows, anchors.select("*", every[0].alias("low"), every[1].alias("high")), index, True, POSITIVES)
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    ranges = anchors.join(listed, "key").select(
        "*",
        F.transform("positives", lambda p: F.ceil(p["score"].cast("decimal(20,0)") / 2).cast("long")).alias("low"),
        F.transform("positives", lambda p: F.floor(p["score"].cast("decimal(20,0)") * 19 / 20).cast("long")).alias("high"),
    )
    ranges = materialize(ranges, "anchors-positives")
    negatives = _searched(rows, ranges, index, False, NEGATIVES).select("key", "anchor_id", "search", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = ranges.select("key", F.posexplode("positives").alias("search", "p")).select("key", "search", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return negatives.join(pairs, ["key", "search"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector of ``embeddings``."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""
