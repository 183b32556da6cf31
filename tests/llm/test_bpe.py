"""The streaming transducer against the tokenizers library, its lookahead, and the decoder."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cueframe.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def mine(text):
    return [i for ids in bpe.load(PATH).encode(text) for i in ids]


def wanted(library, text):
    return library.encode(text, add_special_tokens=False).ids


ODD = st.lists(st.sampled_from([*"abelrstv' \n\t10.!-éÅİΣ日本가ᄀ각̈́ Ᲊ\U0001f600", "<|endoftext|>", "<|", "'re"]), max_size=80).map("".join)


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
@settings(max_examples=120, deadline=None, database=None)
@given(text=st.one_of(ODD, st.text(max_size=60)))
def test_ids_are_the_librarys_whatever_the_blocks(library, block, text):
    old, bpe.BLOCK = bpe.BLOCK, block
    try:
        assert mine(text) == wanted(library, text)
    finally:
        bpe.BLOCK = old


@pytest.mark.parametrize("letters", ["a", "ha", "aeinrst", "thequickbrown"])
def test_a_piece_longer_than_every_buffer(library, letters, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 256)
    rng = random.Random(5)
    for text in ("".join(rng.choice(letters) for _ in range(9_000)), letters * 3_000, "!?" * 4_000):
        assert mine(text) == wanted(library, text)


def test_an_open_piece_holds_a_bounded_buffer(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 160)
    rules, rng = bpe.load(PATH), random.Random(3)
    held, piece, out = 0, bpe.OpenPiece(rules), []
    for _ in range(400):
        out += piece.feed("".join(rng.choice("aeinrst") for _ in range(100)))
        held = max(held, len(piece.buffer))
    assert held <= 2 * rules.lookahead + 160 + 100
    assert len(out) > 10_000


def test_lookahead_of_small_merge_lists():
    """With a+b and b+c the token before the end may change (abc); with b+c, then a+bc, it may so twice."""
    size = {0: 1, 1: 1, 2: 1}
    assert bpe.sufficient_lookahead([(0, 1)], [3], size | {3: 2}) == 1
    assert bpe.sufficient_lookahead([(1, 2), (0, 3)], [3, 4], size | {3: 2, 4: 3}) == 2
    assert bpe.sufficient_lookahead([], [], size) == 0


def test_tokens_that_went_out_never_change(library):
    """Brute force over the claim: whatever follows, tokens that end a lookahead before the read end stay."""
    rules, rng = bpe.load(PATH), random.Random(8)
    for _ in range(15):
        text = "".join(rng.choice("aeinrstlo") for _ in range(rules.lookahead + 200))
        first = rules.merged([rules.plain[b] for b in text.encode()])
        at, stable = 0, []
        for token in first:
            at += rules.size[token]
            if at > len(text) - rules.lookahead:
                break
            stable.append(token)
        for end in ("", "s", "tion", "ing", "".join(rng.choice("aeinrst") for _ in range(50))):
            assert mine(text + "x" + end)[: len(stable)] == stable


def test_decoding(library):
    rules = bpe.load(PATH)
    for text in ("", "Hello, World's naïve 日本 <|endoftext|> x", "😀" * 5):
        ids = wanted(library, text)
        machine = bpe.Decoder(rules)
        assert "".join(machine.feed([i]) for i in ids) + machine.close() == library.decode(ids, skip_special_tokens=False)
    machine = bpe.Decoder(rules, spelled=True)
    said = [machine.feed([i]) for i in wanted(library, "naïve 😀x")]
    assert "".join(said) + machine.close() == "naïve 😀 x "
    assert bpe.Decoder(rules, spelled=True).feed([10**7]) == ""
    machine = bpe.Decoder(rules, spelled=True)
    assert machine.feed([rules.plain[0xE6]]) == "" and machine.close() == "�"


def test_parts_round_trip(spark, monkeypatch):
    rows = [(1, "Many words, one after another. " * 2_000), (1, None), (2, ""), (None, "naïve"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS row", "3 AS ids").repartition(3)
    parts = bpe.encode(docs, PATH)
    assert {r.n for r in parts.groupBy("row", "part").count().withColumnRenamed("count", "n").collect()} == {1}
    got = sorted(((r.doc_id or -1, "".join(x.text for x in sorted(r.xs, key=lambda x: x.part))) for r in bpe.decode(parts, PATH, spelled=True).selectExpr("doc_id", "row", "struct(part, text) AS x").groupBy("doc_id", "row").agg({"x": "collect_list"}).withColumnRenamed("collect_list(x)", "xs").collect()))
    assert got == sorted([(1, "many words , one after another . " * 2_000), (1, ""), (2, ""), (-1, "naïve "), (3, "same "), (3, "same ")])


def test_query_equals_the_library(spark, small, library):
    from cueframe.llm.registry import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op12_bpe"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = wanted(library, texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_rows(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
