"""Packing: concatenate the tokens of all documents and cut them at fixed windows.

Pass one tokenizes once, each distinct piece of a slice of texts a single time, and writes each document's ids with its offset inside its partition; the partition
totals' prefix sums give global offsets; pass two cuts at the multiples of the window.  A document that crosses a window's edge
leaves a boundary record on each side.

Defined cases: null and empty texts hold the end id alone; equal documents are packed once each; an empty table
gives no pieces; other columns are ignored.  A null ``doc_id`` stays null.  Only the last sequence is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import materialize, release, row_slices, utf8

WINDOW, END_ID = 2048, 1
#: Partition totals are 16 bytes each; up to this many are broadcast, more are joined by shuffle.
BROADCAST_PARTITIONS = 500_000
#: Bytes of keys and ids that a worker's table of pieces holds before it is emptied; longer pieces than LONG bytes are not kept.
TABLE_BYTES, LONG = 32 << 20, 64
#: Text bytes that are taken together.
SLICE_BYTES = 1 << 20

#: Texts of other characters than these go to the tokenizer whole: of these, ``_CLASS`` and the tokenizer agree on what is a letter, digit or mark.
_SAFE = "\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u0148\u014a-\u017e"
#: The splitting rule that ``pieces`` stands for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARK = "日"  # outside the safe characters
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(0x180, _OTHER, np.uint8)
    for code in range(0x180):
        char = chr(code)
        out[code] = _BLANK if char in "\t\n\r " else _LETTER if char.isalpha() else _DIGIT if char.isdigit() else _OTHER
    return out


_CLASS = _classes()


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of safe lower-case texts begins and ends: a run of letters, a digit, a run of marks or one of the rule's endings."""
    kind = _CLASS[np.minimum(raw, 0x7F)]
    lead = np.flatnonzero(raw >= 0xC2)
    kind[lead] = kind[lead + 1] = _CLASS[(raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F]
    cut = np.empty(len(raw) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut[at] = True
    quote = np.flatnonzero(raw == 39)
    if len(quote):
        begins = np.zeros(len(raw) + 1, bool)
        begins[at] = True
        quote = quote[(quote == 0) | begins[quote] | (kind[quote - 1] != _OTHER)]
        room = at[np.searchsorted(at, quote, "right")] - quote
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        wide = (room > 2) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for q, width in ((quote[short], 2), (quote[wide], 3)):
            cut[q + 1] = False
            cut[q + width] = True
    edge = np.flatnonzero(cut)
    said = kind[edge[:-1]] != _BLANK
    return edge[:-1][said], edge[1:][said]


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


def piece_keys(raw: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece, eight bytes at a time."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x[:-width] |= x[width:] << np.uint64(8 * width)
    n = (past - first).astype(np.uint64)
    one, two, live, at = n.copy(), n.copy(), np.arange(len(n)), first
    rest = n
    while len(live):
        part = x[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(rest, np.uint64(8)) * np.uint64(8)))
        one[live] = _mixed(one[live] * np.uint64(0x9E3779B97F4A7C15) + part, 0xBF58476D1CE4E5B9)
        two[live] = _mixed(two[live] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part, 0x94D049BB133111EB)
        more = rest > np.uint64(8)
        live, at, rest = live[more], at[more] + 8, rest[more] - np.uint64(8)
    return one, two


class WordTokenizer:
    """Ids of a word-level BPE tokenizer.  A slice's distinct pieces are looked up in a table of hashes, those that are not there are encoded, and the ids
    are gathered by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        rules = json.loads(self.whole.to_str())
        split = [x["pattern"]["Regex"] for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        del rules
        mark = self._ids(_MARK)
        #: None: the vocabulary's rules are not those that ``pieces`` follows, and every text goes to the tokenizer whole.
        self.mark = int(mark[0]) if len(mark) == 1 and split == [_SPLIT] and steps == ["NFC", "Replace", "Lowercase"] else None
        self._clear()

    def _clear(self) -> None:
        """An empty table: keys in order, and where their ids are in ``flat``."""
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and each one's number of ids, from one text in which a mark parts them."""
        ids = np.array(self.whole.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(words) - 1:
            raise RuntimeError("the separator is not a word of its own in this vocabulary")
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _found(self, raw: np.ndarray, begin: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """All ids in one array, and for each piece where its own begin and how many they are; None where different pieces share a hash."""
        if len(self.one) * 24 + self.flat.nbytes > TABLE_BYTES:
            self._clear()
        one, two = piece_keys(raw, begin, past)
        coded = pa.array(one).dictionary_encode()
        code, keys = np.asarray(coded.indices), np.asarray(coded.dictionary)
        example = np.empty(len(keys), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        if (two[example][code] != two).any():
            return None
        at = np.searchsorted(self.one, keys)
        near = np.minimum(at, max(0, len(self.one) - 1))
        known = (self.one[near] == keys) if len(self.one) else np.zeros(len(keys), bool)
        if known.any() and (self.two[near[known]] != two[example[known]]).any():
            self._clear()
            return None
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.first[near[known]], self.count[near[known]]
        flat = self.flat
        if len(new := np.flatnonzero(~known)):
            data = memoryview(raw)
            words = [str(data[a:b], "utf-8") for a, b in zip(begin[example[new]].tolist(), past[example[new]].tolist(), strict=True)]
            ids, size = self._encoded(words)
            first[new], count[new] = len(flat) + np.cumsum(size) - size, size
            flat = np.concatenate([flat, ids])
            kept = new[(past - begin)[example[new]] <= LONG]
            kept = kept[np.argsort(keys[kept])]
            place = at[kept]
            self.one, self.two = np.insert(self.one, place, keys[kept]), np.insert(self.two, place, two[example[kept]])
            self.first, self.count = np.insert(self.first, place, first[kept]), np.insert(self.count, place, count[kept])
            self.flat = flat
        return flat, first[code], count[code]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, in one array, and each text's number of ids."""
        column = column.cast(pa.large_string()).fill_null("")
        safe = np.zeros(len(column), bool)
        if self.mark is not None:
            safe = ~pc.match_substring_regex(column, f"[^{_SAFE}]|<[|]").to_numpy(zero_copy_only=False).astype(bool)
        raw, at = utf8(pc.ascii_lower(column.filter(pa.array(safe))))
        n = np.zeros(len(column), np.int64)
        ids = np.zeros(0, self.kind)
        if len(raw):
            begin, past = pieces(raw, at)
            found = self._found(raw, begin, past) if len(begin) else None
            if len(begin) and found is None:
                safe[:] = False
            elif found:
                flat, first, count = found
                total = np.concatenate([[0], np.cumsum(count)])
                ids = flat[np.repeat(first - total[:-1], count) + np.arange(int(total[-1]))]
                n[safe] = np.diff(total[np.searchsorted(begin, at)])
        whole = {k: self._ids(column[k].as_py()) for k in np.flatnonzero(~safe).tolist()}
        for k, own in whole.items():
            n[k] = len(own)
        n += 1
        ends = np.cumsum(n)
        out = np.full(int(ends[-1]) if len(n) else 0, end_id, self.kind)
        free = np.ones(len(out), bool)
        free[ends - 1] = False
        for k, own in whole.items():
            out[ends[k] - n[k] : ends[k] - 1] = own
            free[ends[k] - n[k] : ends[k]] = False
        out[free] = ids
        return out, n


_LOADED: dict[str, WordTokenizer] = {}


def _loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _parts(text: str) -> list[str]:
    """A long text cut at blanks, which no piece crosses, into parts near SLICE_BYTES (a longer word stands whole)."""
    out, first = [], 0
    while len(text) - first > SLICE_BYTES:
        past = next((k for k in range(first + SLICE_BYTES, len(text)) if text[k] in " \t\n\r"), len(text))
        out.append(text[first:past])
        first = past
    return [*out, text[first:]]


def _token_batches(path: str, end_id: int):
    def coded(coder: WordTokenizer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(column) > 1 or coder.mark is None or len(text := column[0].as_py() or "") <= SLICE_BYTES:
            return coder.encode(column, end_id)
        found = [coder.encode(pa.array([part]), end_id)[0][:-1] for part in _parts(text)]
        ids = np.concatenate([*found, np.array([end_id], coder.kind)])
        return ids, np.array([len(ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = _loaded(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, edges = utf8(batch.column(1))
            for first, past in row_slices(edges, SLICE_BYTES):
                ids, n = coded(coder, batch.column(1).slice(first, past - first))
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                offsets = np.concatenate([[0], np.cumsum(n * ids.itemsize)])
                wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(start), batch.column(0).slice(first, past - first), pa.array(n), wide.cast(pa.binary())], ["part", "local", "doc_id", "n", "ids"]
                )
        release()

    return run


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``part, local, doc_id, n, ids``: each document's ids, little-endian, and its offset within its partition; written once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(_token_batches(tokenizer_path, end_id), "part int, local long, doc_id long, n long, ids binary"), "tokens")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(8)]
            doc, n, start, ids = (batch.column(i).to_pylist() for i in range(4))
            for d, size, at, raw in zip(doc, n, start, ids, strict=True):
                width = len(raw) // size
                wide = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4")
                edges = [0, *range(window - at % window, size, window), size]
                for a, b in zip(edges, edges[1:], strict=False):
                    sequence, offset = divmod(at + a, window)
                    for c, v in zip(cols, (d, a, b - a, zlib.crc32(wide[a:b]), size, sequence, offset, int(a > 0) + 2 * int(b < size)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], PIECE_COLUMNS)

    return run


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece.  ``boundary``: 1 if the document began in an earlier piece, plus 2 if it goes on in a later one."""
    ids = tokens(docs, tokenizer_path, end_id)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition, not per document: the only step that sees them all.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    if totals.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = ids.join(offsets, "part").select("doc_id", "n", (F.col("base") + F.col("local")).alias("at"), "ids")
    return placed.mapInArrow(_cut(window), ", ".join(f"{c} long" for c in PIECE_COLUMNS))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
