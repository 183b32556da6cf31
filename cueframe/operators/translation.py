"""A chunked map through an injected client, with bisection, retries and resumption from stored rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.functions.hashing import content_hash
from cueframe.operators.segmentation import chunks

#: Takes a JSON array of {index, text} and returns one of the same indexes in order.
Client = Callable[[str], str]


def parse_reply(reply: str, indexes: list[int]) -> list[str]:
    """The texts of a reply; ValueError unless it is an array of the wanted indexes in order, each with a text."""
    items = json.loads(reply)
    if not isinstance(items, list) or len(items) != len(indexes):
        raise ValueError(f"{len(indexes)} items wanted")
    for item, index in zip(items, indexes, strict=True):
        if not isinstance(item, dict) or item.get("index") != index or not isinstance(item.get("text"), str):
            raise ValueError(f"item {index} is wrong")
    return [item["text"] for item in items]


def ask(client: Client, rows: list[tuple[int, str]]) -> dict[int, str]:
    """Texts by index; a chunk whose reply is wrong is halved, and a single row that fails is left out."""
    out: dict[int, str] = {}
    stack = [rows]
    while stack:
        part = stack.pop()
        try:
            texts = parse_reply(client(json.dumps([{"index": i, "text": t} for i, t in part], ensure_ascii=False)), [i for i, _ in part])
        except ValueError:
            if len(part) > 1:
                half = (len(part) + 1) // 2
                stack += [part[half:], part[:half]]
            continue
        out.update(zip([i for i, _ in part], texts, strict=True))
    return out


def _map_batches(client: Client):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, idx, texts = [], [], []
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = ask(client, [(r["idx"], r["text"]) for r in rows])
                keys += [key] * len(got)
                idx += list(got)
                texts += list(got.values())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(idx, pa.int64()), pa.array(texts, pa.string())], ["key", "idx", "text"])

    return run


def translate(segments: DataFrame, client: Client, size: int = 20, done: DataFrame | None = None) -> DataFrame:
    """``key, idx, text`` of ``segments`` (``key, idx, text``).  Chunks are counted over all rows, then those in ``done`` are left out, so a resumed run asks for the same chunks."""
    rows = chunks(segments, size, "key", "idx")
    if done is not None:
        rows = rows.join(done.select("key", "idx"), ["key", "idx"], "left_anti")
    asked = rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("rows"))
    out = asked.select("key", "rows").mapInArrow(_map_batches(client), "key long, idx long, text string")
    return out if done is None else done.select("key", "idx", "text").unionByName(out)


def missing(segments: DataFrame, translated: DataFrame) -> DataFrame:
    return segments.join(translated.select("key", "idx"), ["key", "idx"], "left_anti").select("key", "idx")


def completed(segments: DataFrame, client: Client, size: int = 20, rounds: int = 2, store=lambda df: df) -> DataFrame:
    """``translate``, then up to ``rounds`` rounds that ask for each missing row alone.  ``store`` writes a round and reads it back, as a checkpoint."""
    out = store(translate(segments, client, size))
    for _ in range(rounds):
        if missing(segments, out).limit(1).count() == 0:
            return out
        out = store(translate(segments, client, 1, out))
    if first := missing(segments, out).orderBy("key", "idx").first():
        raise ValueError(f"no translation of {first.key}/{first.idx}")
    return out


def fingerprint(segments: DataFrame, model: str, target: str) -> DataFrame:
    """``key, fingerprint``: of the model, the target and every text; texts are hashed one by one, so only digests are gathered."""
    rows = segments.select("key", F.struct("idx", content_hash(F.col("text")).alias("h")).alias("x"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), ",")
    return rows.groupBy("key").agg(content_hash(F.concat_ws("|", F.lit(model), F.lit(target), listed)).alias("fingerprint"))


class Prefixing:
    """A client for tests and queries: each text with a language tag before it."""

    def __init__(self, tag: str) -> None:
        self.tag = tag

    def __call__(self, message: str) -> str:
        return json.dumps([{"index": x["index"], "text": f"[{self.tag}] {x['text']}"} for x in json.loads(message)])
