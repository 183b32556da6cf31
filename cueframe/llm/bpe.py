"""BPE encoding and decoding as streaming transducers.

Encoding reads a text in blocks, normalises and splits each, and sends a piece's symbols through a transducer with a bounded lookahead: a token
goes out once no further symbol can change it.  ``sufficient_lookahead`` derives that bound from the merge list.  What differs between two continuations
of a piece starts at its read end and travels left at most by one token a rule: when rule ``(u, v)`` applies on one side only, ``u`` is the last token that both
sides share.  The next rule ``(u', v')`` that moves it has a higher rank, and the token where both sides part, which is the left end of ``v'``, starts with ``u``.  So the
longest chain of rules, each with the ``u`` of the one before on the left edge of its ``v``, bounds the way, and all tokens further left are final.  A piece of
any length needs a buffer of that bound and a block.

Decoding maps ids to bytes and bytes to text; a character whose bytes are spread over several ids waits until it is whole.

Memory is constant beside the row itself: a table of short pieces, emptied when full, and buffers of ``BLOCK`` characters.  No shuffle; a long document is one task's work.

Defined cases: null and empty texts have no ids and decode to an empty text; rows that are equal, or share a ``doc_id``, are encoded one by one; a null ``doc_id``
stays null; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, pairwise

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm.common import release

#: Characters that are normalised and split together, symbols beyond the lookahead that a buffer takes, and ids that go out together.
BLOCK = 1 << 16
#: Pieces of at most LONG characters are kept in a table of at most KNOWN of them.
KNOWN, LONG = 300_000, 64
PIECES = 10_000
#: The splitting rule that the patterns below stand for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK = r"\t-\r \x85\xa0  -     　"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_PIECES = re.compile(rf"{_ENDINGS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_PIECES = regex.compile(rf"{_ENDINGS}|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
#: What later versions of Unicode than Python's have assigned may be a letter to some tables and not to others.
_LATER = "\u0557"
_LETTERS, _OTHERS = regex.compile(r"\p{L}+"), regex.compile(rf"[^{_BLANK}\p{{L}}\p{{N}}]+")
#: Jamo that a syllable before them takes in: no text is cut there.
_JAMO = ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    out, spare = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if plain else spare))
        spare += not plain
    return out


def sufficient_lookahead(pairs: list[tuple[int, int]], made: list[int], size: dict[int, int]) -> int:
    """How many symbols before the read end the last token that is still open may begin: ``pairs`` in order of rank, the token each makes, and tokens' lengths in symbols."""
    left: dict[int, int] = {}
    reach: dict[int, int] = {}
    most = 0
    for (u, v), new in zip(pairs, made, strict=True):
        far, edge = 0, v
        while edge is not None:
            far = max(far, reach.get(edge, 0))
            edge = left.get(edge)
        far += size[u]
        reach[u] = max(far, reach.get(u, 0))
        left[new] = u
        most = max(most, far)
    return most


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """The code points that Python's tables do not know, as one class."""
    holes = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    edges = [k for k in range(1, len(holes)) if holes[k] != holes[k - 1] + 1]
    spans = zip([holes[k] for k in [0, *edges]], [holes[k - 1] for k in [*edges, len(holes)]], strict=True)
    return re.compile(f"[{''.join(rf'\U{a:08x}-\U{b:08x}' for a, b in spans)}]")


class Bpe:
    """The merge list of a word-level BPE tokenizer with an end-of-word mark, its normaliser and splitting rule."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, steps, splits = rules["model"], rules["normalizer"]["normalizers"], rules["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"].get("Regex") != _SPLIT:
            raise ValueError(f"{path}: another kind of tokenizer")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.plain, self.final = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        pairs = [tuple(vocab[t] for t in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        size = dict.fromkeys([*self.plain, *self.final], 1)
        self.made = []
        for (a, b), texts in zip(pairs, model["merges"], strict=True):
            if a not in size or b not in size:
                raise ValueError(f"{path}: a merge uses what no merge before it makes")
            new = vocab["".join(texts) if isinstance(texts, list) else texts.replace(" ", "", 1)]
            size[new] = size[a] + size[b]
            self.made.append(new)
        self.size, self.rank = size, {p: k for k, p in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs, self.made, size)
        self.added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self._added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        tokens = vocab | self.added
        #: What an id decodes to: its token's name, and the bytes that it stands for (an end of word is a blank).
        self.names = {i: t.encode() for t, i in tokens.items()}
        back = {c: b for b, c in enumerate(letters)}
        ended = lambda t: bytes(back[c] for c in t.removesuffix(end)) + (b" " if end and t.endswith(end) else b"")
        self.bytes = {i: ended(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self._known: dict[str, tuple[int, ...]] = {}
        self._path, self._library = path, None

    def merged(self, symbols: list[int]) -> list[int]:
        """Symbols merged by rank, the leftmost first among equals."""
        if len(symbols) <= LONG:
            return self._merged_short(symbols)
        rank, made, ids = self.rank, self.made, list(symbols)
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return [x for x in ids if x >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        of, none = self.rank.get, len(self.made)
        ranks = [of(p, none) for p in pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = of((ids[i], ids[i + 1]), none)
        return ids

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one whole piece."""
        found = self._known.get(text)
        if found is None:
            if len(text) > LONG:
                found = (*(whole := OpenPiece(self)).feed(text), *whole.close())
            else:
                raw = text.encode()
                found = tuple(self.merged([*[self.plain[b] for b in raw[:-1]], self.final[raw[-1]]]))
                if len(self._known) >= KNOWN:
                    self._known.clear()
                self._known[text] = found
        return found

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, some at a time."""
        at = 0
        for mark in self._added.finditer(text or "") if self._added else ():
            yield from self._plain(text[at : mark.start()])
            yield [self.added[mark.group()]]
            at = mark.end()
        yield from self._plain((text or "")[at:])

    def _plain(self, text: str) -> Iterator[list[int]]:
        held: OpenPiece | None = None
        for block, goes_on in blocks(text):
            if max(block, default="") > _LATER and _unassigned().search(block):
                block, said = self._by_library(block)
            else:
                block, said = normalised(block), None
            out, at = [], 0
            if held is not None:
                at = (_LETTERS if held.letters else _OTHERS).match(block).end()
                out += held.feed(block[:at])
                if at == len(block) and goes_on:
                    yield out
                    continue
                out += held.close()
                held = None
            if said is None:
                said = (_ASCII_PIECES if block.isascii() else _PIECES).findall(block, at)
            else:
                said = [block[max(a, at) : b] for a, b in said if b > at]
            if goes_on:
                held = OpenPiece(self, said[-1][-1].isalpha())
                out += [i for word in said[:-1] for i in self.piece(word)] + held.feed(said[-1])
            else:
                known, piece = self._known.get, self.piece
                for word in said:
                    out += known(word) or piece(word)
            if out:
                yield out
        if held is not None:
            yield held.close()


    def _by_library(self, block: str) -> tuple[str, list[tuple[int, int]]]:
        """A block with code points that Python does not know, normalised and split by the tokenizer's own tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        block = self._library.normalizer.normalize_str(block)
        return block, [span for _, span in self._library.pre_tokenizer.pre_tokenize_str(block)]


class OpenPiece:
    """A piece whose end is not read yet.  The last symbol waits, as the end of a word has a form of its own."""

    def __init__(self, bpe: Bpe, letters: bool = False) -> None:
        self.bpe, self.letters, self.buffer, self.last = bpe, letters, [], None

    def feed(self, text: str) -> list[int]:
        """The ids that are final after ``text``."""
        raw = text.encode()
        if not raw:
            return []
        if self.last is not None:
            self.buffer.append(self.bpe.plain[self.last])
        self.buffer += [self.bpe.plain[b] for b in raw[:-1]]
        self.last = raw[-1]
        out: list[int] = []
        wide, at = self.bpe.lookahead + BLOCK // 16, 0
        while len(self.buffer) - at > wide + self.bpe.lookahead:
            window = self.buffer[at : at + wide]
            stable = len(window) - self.bpe.lookahead
            for token in self.bpe.merged(window):
                stable -= self.bpe.size[token]
                if stable < 0:
                    break
                out.append(token)
                at += self.bpe.size[token]
        del self.buffer[:at]
        return out

    def close(self) -> list[int]:
        return self.bpe.merged([*self.buffer, self.bpe.final[self.last]]) if self.last is not None else []


def normalised(text: str) -> str:
    """Canonical composition and lower case, a character at a time (no final sigma of its own)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _inside(text: str, at: int) -> bool:
    """Whether ``text`` may be cut at ``at`` within a piece: two letters or two marks, no quote near, and nothing that joins the character before."""
    kind, code = unicodedata.category(text[at]), ord(text[at])
    if kind[0] == "M" or "Cn" in (kind, unicodedata.category(text[at - 1])) or len(text[at - 1].lower()) > 1 or any(a <= code <= b for a, b in _JAMO) or "'" in text[max(0, at - 3) : at + 3]:
        return False
    pair = text[at - 1 : at + 1]
    return bool(_LETTERS.fullmatch(pair) or _OTHERS.fullmatch(pair) and unicodedata.category(pair[0])[0] != "M")


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in blocks that are normalised and split alike alone, cut at blanks; where a block has none, within a piece, which is then marked as going on."""
    at, n = 0, len(text)
    while n - at > BLOCK:
        cut = max(text.rfind(" ", at + 1, at + BLOCK), text.rfind("\n", at + 1, at + BLOCK))
        goes_on = cut < 0
        if goes_on:
            cut = next((k for k in range(at + BLOCK, at + 1, -1) if _inside(text, k)), -1)
            if cut < 0:
                cut, goes_on = next((k for k in (text.find(" ", at + BLOCK), text.find("\n", at + BLOCK)) if k > 0), n), False
        yield text[at:cut], goes_on
        at = cut
    yield text[at:], False


class Decoder:
    """Ids to text, some at a time.  ``spelled`` gives what the bytes mean; else tokens are named, with a blank between, as a tokenizer without a decoder does."""

    def __init__(self, bpe: Bpe, spelled: bool = False) -> None:
        self.table, self.between, self.begun = (bpe.bytes, b"", False) if spelled else (bpe.names, b" ", False)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is whole after ``ids``; ids that are not in the vocabulary say nothing."""
        said = [self.table[i] for i in ids if i in self.table]
        if not said:
            return ""
        raw = self.between.join(said)
        if self.begun:
            raw = self.between + raw
        self.begun = True
        return self.machine.decode(raw)

    def close(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The rules of ``path``, read once by each worker."""
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, row, part, ids``: the ids of each row of ``docs`` in parts of at most some thousand, from 0; a row without ids has one empty part.  ``row`` is the row's own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = load(path), (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                part = 0
                for ids in (part for ids in bpe.encode(text.as_py()) for part in batched(ids, PIECES)):
                    yield _rows(PART, [doc], [row], [part], [list(ids)])
                    part += 1
                if not part:
                    yield _rows(PART, [doc], [row], [0], [[]])
        release()

    return _texts(docs).mapInArrow(run, "doc_id long, row long, part long, ids array<int>")


def decode(parts: DataFrame, path: str, spelled: bool = False) -> DataFrame:
    """``doc_id, row, part, text`` of ``encode``'s rows: a row's parts in order give its text; a character spread over two parts is in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, now, machine, at = load(path), None, None, (None, None)
        for batch in batches:
            for doc, row, part, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if machine is None or row != now:
                    if machine is not None and (rest := machine.close()):
                        yield _rows(SAID, [at[0]], [now], [at[1] + 1], [rest])
                    now, machine = row, Decoder(bpe, spelled)
                at = doc, part
                yield _rows(SAID, [doc], [row], [part], [machine.feed(ids or ())])
        if machine is not None and (rest := machine.close()):
            yield _rows(SAID, [at[0]], [now], [at[1] + 1], [rest])

    rows = parts.select("doc_id", "row", "part", "ids").repartition("row").sortWithinPartitions("row", "part")
    return rows.mapInArrow(run, "doc_id long, row long, part long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each row's ids and what they decode to, digested as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        numbers = {i: str(i) for i in bpe.names}
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, coded, said, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
                for ids in bpe.encode(text.as_py()):
                    coded.update(((" " if n else "") + " ".join([numbers[i] for i in ids])).encode())
                    said.update(machine.feed(ids).encode())
                    n += len(ids)
                said.update(machine.close().encode())
                out.append((doc, n, coded.hexdigest(), said.hexdigest()))
            yield _rows(DIGEST, *zip(*out, strict=True)) if out else _rows(DIGEST, [], [], [], [])
        release()

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


PART = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int32()))])
SAID = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("text", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _rows(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded, and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
