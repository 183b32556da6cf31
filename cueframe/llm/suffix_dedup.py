"""Exact substring dedup with deep-shallow suffix sorting.

Every ``LENGTH``-byte string of a document (a window) that also starts earlier - in a document of smaller id, or earlier in the same
one - is found, and the bytes it covers are removed.

1. A window's anchor is the least hashed ``GRAM``-byte string in it, the leftmost of equal ones; it depends on the window's bytes alone, so equal windows have
   equal anchors at equal offsets.  Neighbouring windows with one anchor make a run; only runs whose anchor occurs elsewhere can hold a repeat.
2. Runs are dealt by anchor.  Of runs with equal bytes (by two 64-bit hashes) all but the earliest are repeats.  The earliest of each content, where one anchor has
   several contents, need sorting.  Repeats within a slice of a task's rows are known at once and are not dealt; of an anchor with ``MANY`` contents in one
   slice two are dealt, which tells the others of that anchor, and the rest go straight to the sort.
3. Their bytes are fetched and dealt by anchor and the ``HALF`` bytes on one side of it (each window has so many on one side), which parts the
   contents of a frequent anchor.  The suffixes that start at the anchors, and the reversed prefixes that end there, are sorted: multikey partitioning by
   eight-byte keys down to ``SHALLOW`` bytes, then a blind trie for each group that is still equal.  The common-prefix lengths of neighbours say
   which windows are equal, and all but the earliest of those are repeats.  Where more than ``MOST_ROWS`` rows have one key (the edge of a passage that very many
   documents share), the windows of these rows are taken one by one instead and their earliest found by an aggregate, so no key is gathered in one task.

Defined cases: null and empty texts, and texts under LENGTH bytes, lose nothing; rows that share a ``doc_id`` are versions of one document: equal positions of theirs are not earlier
than each other, and each loses what any of them loses at these positions; rows without a ``doc_id`` lose nothing and make nothing repeat; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import bounded, materialize, release, row_slices, utf8

LENGTH, GRAM = 100, 24
SIDE = LENGTH - GRAM
HALF = SIDE // 2
SHALLOW = 24
#: Longer texts are taken in pieces that overlap by LENGTH - 1 bytes.
PIECE = 8 << 20
#: Groups per shuffle partition, so that hashing spreads them evenly.
SPREAD = 8
#: Contents of one anchor in a slice, and rows of one key, over which they are not gathered.
MANY, MOST_ROWS = 16, 20_000
_PLACE_BITS = np.uint64(24)
_U = np.uint64
_BASE = 0xD1342543DE82EF95


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, width, base = raw.astype(np.uint64) + _U(1), 1, _BASE
    eight = h
    while width < 16:
        h = h[:-width] * _U(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
        if width == 8:
            eight, low = h, base
    return _mixed(h[:-8] * _U(low) + eight[16:])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, start in the row, number of windows, offset of the anchor in the run, anchor hash, content hash."""
    n = len(raw)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    h = gram_hashes(raw)
    place = np.arange(len(h), dtype=np.uint64)
    least = _least((h & ~((_U(1) << _PLACE_BITS) - _U(1))) | place, SIDE + 1)
    anchor = (least & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
    last = np.full(len(anchor), -1, np.int64)
    sizes = np.diff(at)
    valid = np.zeros(len(anchor) + 1, np.int32)
    rows = np.flatnonzero(sizes >= LENGTH)
    np.add.at(valid, at[rows], 1)
    np.add.at(valid, at[rows + 1] - LENGTH + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    last[inside] = anchor[inside]
    # An anchor lies in one row, so runs of different rows differ in it.
    edge = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
    size = np.diff(np.r_[edge, len(last)])
    keep = last[edge] >= 0
    start, size = edge[keep], size[keep]
    anchor = last[start]
    row = np.searchsorted(at, start, "right") - 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
    content = _mixed((sums[start + size + LENGTH - 1] - sums[start]) * down[start] + size.astype(np.uint64))
    return row, start - at[row], size, anchor - start, h[anchor], content


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        found = []
        for base in (0xA24BAED4963EE407, pow(0xA24BAED4963EE407, -1, 1 << 64)):
            x = np.full(1 << max(21, n.bit_length()), base, np.uint64)
            x[0] = 1
            found.append(np.cumprod(x))
        _POWERS[:] = found
    return _POWERS


def _repeats(order: np.ndarray, keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over sorted rows: which begin a new group of equal keys, and which are later than their group's first (doc, start)."""
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    later = (doc[order] != doc[order][first]) | (start[order] != start[order][first])
    return fresh, later


RUN_TYPES = {"doc": np.int64, "start": np.int64, "size": np.uint8, "off": np.uint8, "anchor": np.uint64, "content": np.uint64}


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of an array: the shuffle's compression then sees the like bytes together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


#: Blobs of runs that need no dealing: known repeats, and contents of an anchor that has many.
SEEN, DIRECT = -1, -2


def _run_batches(groups: int, many: int):
    names = ["pid", *RUN_TYPES]

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        raw, at = utf8(batch.column(1))
        ids = batch.column(0).to_pylist()
        for first, past in row_slices(at):
            begin, end = int(at[first]), int(at[past])
            if past == first + 1 and end - begin > PIECE:
                for k in range(begin, end - LENGTH + 1, PIECE):
                    part = raw[k : min(end, k + PIECE + LENGTH - 1)]
                    yield ids[first:past], part, np.array([0, len(part)]), np.array([k - begin])
            else:
                yield ids[first:past], raw[begin:end], at[first : past + 1] - begin, np.zeros(past - first, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, at, base in pieces(batch):
                row, start, size, off, anchor, content = runs(raw, at)
                known = np.array([i is not None for i in ids])
                doc = np.array([i or 0 for i in ids], np.int64)[row]
                start = start + base[row]
                # Equal contents of one slice of rows: the earliest and, with size 0 for its content, each later one's place.
                order = np.lexsort((start, doc, content, anchor))
                order = order[known[row[order]]]
                _, later = _repeats(order, (anchor, content), doc, start)
                pid = (anchor % _U(groups)).astype(np.int32)
                cols = {"doc": doc, "start": start, "size": size, "off": off, "anchor": anchor, "content": content}
                first, seen = order[~later], order[later]
                lead = np.flatnonzero(np.r_[True, anchor[first][1:] != anchor[first][:-1]]) if len(first) else np.zeros(0, np.int64)
                count = np.diff(np.append(lead, len(first)))
                place = np.arange(len(first)) - np.repeat(lead, count)
                direct = (np.repeat(count, count) >= many) & (place >= 2)
                out: list[tuple] = []

                def blob(p: int, part: np.ndarray, kinds: tuple[str, ...], cols=cols, doc=doc, start=start, out=out) -> None:
                    part = part[np.lexsort((start[part], doc[part]))]
                    out.append((p, *[_planes(cols[c][part].astype(t)) if c in kinds else b"" for c, t in RUN_TYPES.items()]))

                dealt = first[~direct]
                dealt = dealt[np.argsort(pid[dealt], kind="stable")]
                ids_, at_ = np.unique(pid[dealt], return_index=True)
                for p, a, b in zip(ids_, at_, [*at_[1:], len(dealt)], strict=False):
                    blob(int(p), dealt[a:b], tuple(RUN_TYPES))
                if len(seen):
                    blob(SEEN, seen, ("doc", "start", "size", "off"))
                if direct.any():
                    blob(DIRECT, first[direct], ("doc", "start", "size", "off", "anchor"))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int32() if not k else pa.binary()) for k in range(len(names))], names)

    return run


FINDING_COLUMNS = "doc_id long, start long, size int, off int, anchor long, again boolean"


def _findings(doc: np.ndarray, start: np.ndarray, size: np.ndarray, off: np.ndarray, anchor: np.ndarray, again: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": doc, "start": start, "size": size.astype(np.int32), "off": off.astype(np.int32), "anchor": anchor.view(np.int64), "again": again})


def _resolve(table: pa.Table) -> pa.Table:
    """The runs of one group of anchors: repeats (``again``), and the earliest runs of anchors with several contents."""
    doc, start, size, off, anchor, content = (_joined(table, c) for c in RUN_TYPES)
    order = np.lexsort((start, doc, content, anchor))
    fresh, later = _repeats(order, (anchor, content), doc, start)
    lead = np.zeros(len(order), bool)
    lead[:1] = True
    lead[1:] = anchor[order][1:] != anchor[order][:-1]
    group = np.cumsum(lead) - 1
    several = np.bincount(group, weights=fresh, minlength=1)[group] > 1 if len(order) else np.zeros(0, bool)
    again, need = order[later], order[~later & several]
    both = np.concatenate([again, need])
    return _findings(doc[both], start[both], size[both], off[both], anchor[both], np.arange(len(both)) < len(again))


def _straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs that were not dealt, as findings: known repeats are repeats, and the contents of an anchor with many need sorting."""
    for batch in batches:
        for row in range(batch.num_rows):
            table = pa.Table.from_batches([batch.slice(row, 1)])
            doc, start, size, off, anchor = (_joined(table, c) for c in list(RUN_TYPES)[:5])
            seen = table["pid"][0].as_py() == SEEN
            yield from _findings(doc, start, size, off, np.zeros(len(doc), np.uint64) if seen else anchor, np.full(len(doc), seen)).to_batches()
    release()


def _joined(table: pa.Table, name: str) -> np.ndarray:
    kind = RUN_TYPES[name]
    parts = [_unplanes(x, kind) for x in table[name].to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


CONTEXT_COLUMNS = "pid int, key long, doc long, at long, low int, high int, bytes binary"


def _context_batches(groups: int):
    """Texts with the runs that need sorting -> their bytes, for the windows with HALF bytes before the anchor and for those with HALF after it."""
    import xxhash

    names = [c.split()[0] for c in CONTEXT_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            data, rows = memoryview(raw), []
            for row, needs in enumerate(batch.column(2).to_pylist()):
                if not needs:
                    continue
                doc, base, past = batch.column(0)[row].as_py(), int(at[row]), int(at[row + 1])
                for need in needs:
                    start, size, off, anchor = need["start"], need["size"], need["off"], need["anchor"]
                    a = base + start + off
                    if a + GRAM > past:  # another version of the document
                        continue
                    lead = anchor.to_bytes(8, "little", signed=True)
                    least, most = off - size + 1, off
                    for low, high, side in ((max(HALF, least), most, data[a - HALF : a] if most >= HALF else b""), (least, min(HALF - 1, most), data[a + GRAM : a + GRAM + HALF])):
                        if low <= high:
                            key = xxhash.xxh3_64_intdigest(lead + (b"L" if low >= HALF else b"R") + bytes(side))
                            rows.append((key % groups, key - (1 << 63), doc, start + off, low, high, bytes(data[a - high : a - low + LENGTH])))
                if len(rows) >= 20_000:
                    yield _records(rows, names)
                    rows = []
            yield _records(rows, names)
        release()

    return run


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names)


def _common(s: bytes, t: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    return len(s) - ((int.from_bytes(s, "big") ^ int.from_bytes(t, "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorts strings of one length: their order, and each one's common prefix with the one before it (the first: 0).

    A node is ``[depth, {byte: child}]`` and a leaf a list of equal strings' numbers.  A search follows the bytes at the nodes' depths
    alone, compares with one leaf, and so learns where to branch.
    """
    if len(strings) == 2:
        s, t = strings
        return ([0, 1] if s <= t else [1, 0]), [0, _common(s, t)]
    root: tuple | list = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        same = _common(s, strings[node[0]])
        if same == len(s):
            node.append(i)
            continue
        other, parent, node = strings[node[0]], None, root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == same:
            node[1][s[same]] = [i]
        else:
            split = (same, {other[same]: node, s[same]: [i]})
            if parent is None:
                root = split
            else:
                parent[1][s[parent[0]]] = split
    order: list[int] = []
    shared: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, list):
            order += node
            shared += [before] + [len(strings[0])] * (len(node) - 1)
        else:
            kids = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in kids[:-1]] + [(kids[-1][1], before)]
    return order, shared


def deep_shallow(key: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows of ``strings`` (bytes, the width a multiple of 8) within equal keys: ranks in order, and each one's common prefix with the one
    before it (-1 at a key's first)."""
    n, width = strings.shape
    order = np.argsort(key, kind="stable")
    shared = np.full(n, -2, np.int64)
    new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    shared[new] = -1
    words = strings.view(">u8").astype(np.uint64)
    for depth in range(0, SHALLOW, 8):
        group = np.cumsum(new) - 1
        active = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if n else np.zeros(0, np.int64)
        if not len(active):
            break
        word = words[order[active], depth // 8]
        moved = np.lexsort((word, group[active]))
        order[active], word = order[active][moved], word[moved]
        cut = np.flatnonzero(~new[active][1:] & (word[1:] != word[:-1])) + 1
        differ = word[cut] ^ word[cut - 1]
        lead = np.zeros(len(cut), np.int64)
        for byte in range(1, 8):
            lead += differ < (_U(1) << _U(64 - 8 * byte))
        shared[active[cut]] = depth + lead
        new[active[cut]] = True
    # The groups that are still equal down to SHALLOW.
    edge = np.flatnonzero(new)
    size = np.diff(np.r_[edge, n])
    tail = np.ascontiguousarray(strings[:, SHALLOW:])
    for first, m in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        rows = order[first : first + m]
        placed, common = blind_trie([tail[r].tobytes() for r in rows])
        order[first : first + m] = rows[placed]
        shared[first + 1 : first + m] = np.array(common[1:]) + SHALLOW
    return order, shared


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that rows share if and only if they have one key and agree to ``depth``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum((shared < depth) | (shared == -1))
    return out


def equal_windows(key: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(rows, SIDE + 1) flags: the window with the anchor at that offset repeats an earlier one.

    Row i stands for the windows whose anchor offset is low..high; its bytes run from ``high`` bytes before the anchor to the end of the last window.
    """
    n = len(key)
    lane = np.arange(-(-SIDE // 8) * 8)
    before = lane[None, :] < high[:, None]
    left = np.where(before, data[np.where(before, (edge[:-1] + high)[:, None] - 1 - lane, 0)], 0).astype(np.uint8)
    first = edge[:-1] + high + GRAM
    after = lane[None, :] < (edge[1:] - first)[:, None]
    right = np.where(after, data[np.where(after, first[:, None] + lane, 0)], 0).astype(np.uint8)
    sorted_left, sorted_right = deep_shallow(key, left), deep_shallow(key, right)
    out = np.zeros((n, SIDE + 1), bool)
    by_place = np.lexsort((at, doc))
    for o in range(int(low.min()), int(high.max()) + 1):
        rows = by_place[(low[by_place] <= o) & (o <= high[by_place])]
        if len(rows) < 2:
            continue
        same = _classes(*sorted_left, o)[rows] * (n + 1) + _classes(*sorted_right, SIDE - o)[rows]
        order = rows[np.argsort(same, kind="stable")]
        value = np.sort(same, kind="stable")
        _, later = _repeats(np.arange(len(order)), (value,), doc[order], at[order])
        out[order[later], o] = True
    return out


def _sort_group(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    column = table["bytes"].combine_chunks() if isinstance(table["bytes"], pa.ChunkedArray) else table["bytes"]
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, raw = column.buffers()
    edge = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw, np.uint8)
    key, doc, at, low, high = (np.asarray(table[c]) for c in ("key", "doc", "at", "low", "high"))
    again = equal_windows(key, doc, at, low.astype(np.int64), high.astype(np.int64), data, edge)
    # Runs of neighbouring repeated windows; the highest offset is the first start.
    step = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return pa.table({"doc_id": doc[row], "start": at[row] - (end - 1), "size": (end - begin).astype(np.int32)})


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of frequent keys (doc, at, low, high, bytes) -> each of their windows: two hashes of its bytes, and where it starts."""
    import xxhash

    for batch in batches:
        rows = []
        for doc, at, low, high, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for off in range(low, high + 1):
                value = xxhash.xxh3_128_intdigest(data[high - off : high - off + LENGTH])
                rows.append(((value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63), doc, at - off))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["one", "two", "doc_id", "start"])
    release()


def _frequent(rows: DataFrame) -> DataFrame:
    """Repeated windows among rows whose key is frequent: all but the earliest of each, found by an aggregate."""
    windows = materialize(rows.select("doc", "at", "low", "high", "bytes").mapInArrow(_window_batches, "one long, two long, doc_id long, start long"), "frequent-windows")
    place = F.struct("doc_id", "start")
    least = windows.groupBy("one", "two").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select("one", "two", "least")
    again = windows.join(least, ["one", "two"]).where(F.struct("doc_id", "start") != F.col("least"))
    return again.select("doc_id", "start", F.lit(1).alias("size"))


def repeated_windows(docs: DataFrame, many: int = MANY, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The documents dealt by id (``doc_id, text``), and ``doc_id, start, size``: ``size`` windows from ``start`` on repeat earlier ones."""
    spark = docs.sparkSession
    groups = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = materialize(docs.mapInArrow(_run_batches(groups, many), "pid int, " + ", ".join(f"{c} binary" for c in RUN_TYPES)), "run-blobs")
    straight = blobs.where("pid < 0").mapInArrow(_straight, FINDING_COLUMNS)
    found = materialize(blobs.where("pid >= 0").groupBy("pid").applyInArrow(_resolve, FINDING_COLUMNS).unionByName(straight), "runs")
    needs = found.where("NOT again").groupBy(F.col("doc_id").alias("n_doc")).agg(F.collect_list(F.struct("start", "size", "off", "anchor")).alias("needs"))
    # Both joins of the texts (this, and that of `removed`) are left joins on one key.
    texts = docs.join(needs.hint("shuffle_hash"), docs["doc_id"] == F.col("n_doc"), "left").select("doc_id", "text", "needs")
    context = materialize(texts.where("needs IS NOT NULL").mapInArrow(_context_batches(groups), CONTEXT_COLUMNS), "contexts")
    # At most rows / most_rows keys are frequent.
    often = materialize(context.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("key"), "frequent-keys")
    few = often.count() == 0
    rest = context if few else bounded(context, often, "key", "frequent-keys", "left_anti")
    sorted_ = rest.groupBy("pid").applyInArrow(_sort_group, "doc_id long, start long, size int")
    spans = found.where("again").select("doc_id", "start", "size").unionByName(sorted_)
    return docs, spans if few else spans.unionByName(_frequent(bounded(context, often, "key", "frequent-keys")))


def covered(size: int, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Flags of the bytes that the repeated windows cover."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, np.minimum(start, size), 1)
    np.add.at(step, np.minimum(start + windows + LENGTH - 1, size), -1)
    return np.cumsum(step[:-1]) > 0


def _removed_batches(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            data, edges, cuts, kept = memoryview(raw), at.tolist(), [], []
            for row, spans in enumerate(batch.column(2).to_pylist()):
                a, b = edges[row], edges[row + 1]
                if not spans:
                    gone, n_spans, rest = 0, 0, bytes(data[a:b])
                else:
                    flags = covered(b - a, np.array([s["start"] for s in spans]), np.array([s["size"] for s in spans]))
                    gone, n_spans = int(flags.sum()), int(np.count_nonzero(flags[1:] & ~flags[:-1])) + int(flags[:1].sum())
                    rest = raw[a:b][~flags].tobytes()
                cuts.append((b - a, gone, n_spans))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            cols = list(zip(*cuts, strict=True)) if cuts else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), pa.int64()) for c in cols], pa.array(kept, pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def removed(docs: DataFrame, digest: bool = False, many: int = MANY, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes that stay, or their SHA-256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, spans = repeated_windows(docs, many, most_rows)
    spans = spans.groupBy(F.col("doc_id").alias("s_doc")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    rows = texts.join(spans.hint("shuffle_hash"), texts["doc_id"] == F.col("s_doc"), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed_batches(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")
