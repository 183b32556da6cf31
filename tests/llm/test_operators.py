"""HTML, media, near-duplicate, chat, decontamination and packing operators against brute force, round trips and defined cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cueframe.llm import chat, decontamination, html_extract, matroska, minhash, packing

DOCS = "doc_id long, text string, a string, b string, band long, comp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS)


def words(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 40)) for _ in range(n)]


# Near duplicates


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_truth(rows, k):
    sets = {d: shingles(t, k) for d, t in rows}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two")]
    at = 10
    for _ in range(6):
        base = words(rng, 60)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(at + k, rows[20][1].upper()) for k in range(9)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark, near_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, near_rows), shingle=4).collect()}
    assert got == near_truth(near_rows, 4)
    kept = minhash.one_of_each(frame(spark, near_rows), shingle=4)
    assert kept.columns == frame(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in near_truth(near_rows, 4).items() if c == d}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


# Decontamination


def test_leaks_within_the_budget_are_found_and_others_are_not(spark):
    rng = random.Random(2)
    item = " ".join(words(rng, 40))
    budget = int(decontamination.RATE * len(item))
    near = list(item)
    for k in range(budget):
        near[k * len(near) // budget] = "#"
    far = list(item)
    for k in range(3 * budget):
        far[k * len(far) // (3 * budget)] = "#"
    pad = " ".join(words(rng, 300))
    rows = [(1, f"{pad} {item.upper()} {pad}"), (2, f"{pad} {''.join(near)} {pad}"), (3, f"{pad} {''.join(far)} {pad}"), (4, None), (5, ""), (6, pad), (7, item[: len(item) // 2]), (8, item.replace(" ", " \n\t"))]
    items = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "short", "z")], "item_id long, text string, a string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(frame(spark, rows), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (8, 1)} and found[1, 1] == found[8, 1] == 0 and 0 < found[2, 1] <= budget
    assert {r.doc_id for r in decontamination.without_leaks(frame(spark, rows), items).collect()} == {3, 4, 5, 6, 7}
    assert decontamination.leaks(frame(spark, []), items).count() == 0


def least_edits(text: str, item: str) -> int:
    """Edits between the item and the nearest part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, char in enumerate(item, 1):
        above, row[0] = row[:], i
        for j, other in enumerate(text, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (char != other))
    return min(row)


def test_leaks_agree_with_every_alignment(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 64)
    monkeypatch.setattr(decontamination, "PAIRS", 50)
    rng = random.Random(5)
    letters = "abcé日 "
    items = ["".join(rng.choices(letters, k=rng.randrange(12, 90))) for _ in range(12)] + ["=" * 60, "ab" * 30]

    def damaged(text: str, times: int) -> str:
        for _ in range(times):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "x", "xy"]) + text[k + rng.choice([0, 1]) :]
        return text

    docs = ["".join(rng.choices(letters, k=40)) + damaged(rng.choice(items), rng.randrange(9)) + "".join(rng.choices(letters, k=40)) for _ in range(60)] + ["=" * 200, "", "ab" * 45]
    index = decontamination.Index(list(enumerate(items)))
    texts, shown = [decontamination.normal(t) for t in docs], [decontamination.normal(t) for t in items]
    want = {(d, index.ids[i]): got for d, t in enumerate(texts) for i in range(len(index.ids)) if (got := least_edits(t, shown[index.ids[i]])) <= index.edits[i]}
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(frame(spark, list(enumerate(docs))), table).collect()}
    assert found == want and len(want) > 15


def test_repeated_characters_take_bounded_memory():
    import resource

    index = decontamination.Index([(k, "=" * 300 + chr(97 + k) * 20) for k in range(5)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "=" * 20_000
    index.regions(decontamination.codes(text), np.zeros(1, np.int64))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


# Matroska


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 4096, 40_000, 200_001])
def test_media_round_trip(size):
    data = matroska.padded(bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)))
    media = matroska.demux(matroska.mux(data))
    assert matroska.payload(matroska.mux(data), media) == data and len(data) % 64 == 0 and data
    assert [at for _, _, at in media.cues] == media.clusters
    # A tick is a sample of 125,000 ns, and each frame starts after those before it.
    assert [p[2] for p in media.packets] == [k * matroska.FRAME * 125_000 for k in range(len(media.packets))] and all(p[3] for p in media.packets)


def test_lacing_of_all_kinds_is_read():
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d"]
    xiph = bytes([3]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    block = matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x82" + xiph)
    body = matroska.uint(matroska.TIMESTAMP, 5) + block + matroska.element(matroska.SIMPLE_BLOCK, matroska._block(1, 1, frames)) + matroska.element(matroska.SIMPLE_BLOCK, matroska._block(1, 2, frames[:1] * 3))
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + matroska.element(matroska.CLUSTER, body)
    media = matroska.demux(data)
    assert [data[at : at + n] for _, _, _, _, at, n in media.packets] == 2 * (frames + frames + frames[:1] * 3)


def test_groups_stripped_headers_and_odd_numbers():
    m = matroska
    encoding = m.element(m.ENCODINGS, m.element(m.ENCODING, m.element(m.COMPRESSION, m.uint(m.ALGORITHM, 3) + m.element(m.SETTINGS, b"HD"))))
    audio = m.element(m.AUDIO, m.element(m.RATE, np.array([1000.0], ">f4").tobytes()) + m.uint(m.DEPTH, 8) + m.uint(m.CHANNELS, 1))
    track = m.element(m.TRACKS, m.element(m.TRACK, m.uint(m.TRACK_NUMBER, 1) + m.element(m.CODEC, b"A_PCM/INT/LIT") + audio + encoding))
    block = m.element(m.BLOCK, b"\x81\x00\x02\x04\x01" + b"ab" * 2)
    groups = m.element(m.BLOCK_GROUP, block) + m.element(m.BLOCK_GROUP, m.uint(m.REFERENCE, 1) + block)
    data = m.element(m.SEGMENT, track + m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 5) + groups))
    media = m.demux(data)
    assert [(p[2], p[3]) for p in media.packets] == [(7_000_000, True), (9_000_000, True), (7_000_000, False), (9_000_000, False)]
    assert m.payload(data, media) == b"HDab" * 4
    for size in (1, 3, 5):
        with pytest.raises(m.Malformed):
            m.demux(m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.TRACK, m.element(m.AUDIO, m.element(m.RATE, b"x" * size))))))


def test_packet_table_of_bad_files(spark):
    good = matroska.mux(b"x" * 1000)
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"\x00junk")), (4, bytearray(good[:40]))], "id long, content binary")
    got = matroska.packet_table(rows, "id", "content").collect()
    assert {r.id for r in got} <= {1, 4} and sum(r.byte_length for r in got if r.id == 1) == 1000


def test_packet_table_passes_over_odd_numbers_and_flipped_bytes(spark):
    m = matroska

    def media(rate, ticks=b"\x05"):
        audio = m.element(m.AUDIO, m.element(m.RATE, np.array([rate], ">f4").tobytes()) + m.uint(m.DEPTH, 8) + m.uint(m.CHANNELS, 1))
        track = m.element(m.TRACKS, m.element(m.TRACK, m.uint(m.TRACK_NUMBER, 1) + m.element(m.CODEC, b"A_PCM/INT/LIT") + audio))
        block = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x02\x04\x01" + b"ab" * 2))
        return m.element(m.SEGMENT, track + m.element(m.CLUSTER, m.element(m.TIMESTAMP, ticks) + block))

    good, rng = matroska.mux(bytes(range(256)) * 3), np.random.default_rng(0)
    files = [media(1000.0), media(float("nan")), media(float("inf")), media(1e-45), media(1000.0, b"\xff" * 7), media(1000.0, b"\xff" * 8)]
    for _ in range(400):
        raw = np.frombuffer(good, np.uint8).copy()
        raw[rng.integers(0, min(len(raw), 400), 3)] = rng.integers(0, 256, 3)
        files.append(raw.tobytes())
    rows = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "id long, content binary")
    got = {r.id for r in matroska.packet_table(rows, "id", "content").collect()}
    assert 0 in got and not got & {1, 4, 5}


# HTML


def test_main_text_leaves_boilerplate_out(spark):
    page = lambda k: (
        f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><a>menu</a></nav><div class='cookie'>notice</div><article><h1>Title {k}</h1><p>First   &amp; <b>bold</b>\n text {k}<br>on"
        f"<p>Second {k}</article><div class='share-box'>shared words</div><div class=comments>talk</div><footer>&copy;</footer></body></html>"
    )
    rows = [(k, f"http://h.example.com/{k}", page(k), "c") for k in range(9)] + [(90, None, None, "c"), (91, "odd", "", "c"), (92, "http://x.org", "plain <i>text", "c")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[3][0] == "Title 3\nFirst & bold text 3 on\nSecond 3"
    assert got[90] == got[91] == ("", 0) and got[92] == ("plain text", 10)
    assert all(n == len(t) for t, n in got.values())


def test_inline_elements_do_not_decide_on_paragraphs_of_a_large_host(spark):
    def page(k):
        rare = f"<p><a href=x>Link {k}</a> opens this.<p><em>Correction {k}</em></p><figure><img><figcaption>Caption {k}</figcaption></figure>" if k % 100 == 7 else "<figure><img></figure>"
        return (
            f"<body><div class=page><span class=tagline>Always the same</span><article><p>Text {k} with <a href=x>a link</a> and <em>stress</em> within.{rare}"
            f"<p> <a class=tag>News</a> of day {k}<span class=share>share</span> <a class=tag>News</a> again</article></div></body>"
        )

    rows = [(k, "http://big.example.com/x", page(k)) for k in range(1200)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1200):
        rare = [f"Link {k} opens this.", f"Correction {k}", f"Caption {k}"] if k % 100 == 7 else []
        assert got[k] == [f"Text {k} with a link and stress within.", *rare, f"News of day {k} News again"]


def framed(k):
    """A page whose frame has names that say nothing: fixed, half fixed and varied parts around the text."""
    side = f"<div class=x3><ul><li>Offer {k % 2}</li><li>Terms</li></ul></div>"
    return (
        f"<body><div class=x1><span>Your daily paper</span></div><div class='text has-sidebar'><h1>Title {k}</h1><p>Body {k} of <b>page {k}</b>, <span class=ad>buy</span> long enough.</p>{'<p>More %d</p>' % k if k % 3 else ''}</div>"
        f"{side}<div class='content sidebar'>{'A kept text of page %d. ' % k * 20}</div></body>"
    )


def test_the_tree_decides_where_names_say_nothing(spark):
    rows = [(k, f"http://x.example.com/{k}", framed(k)) for k in range(40)] + [(100 + k, f"http://y{k}.example.com/", framed(k)) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.main_text(pages).collect()}
    for k in range(40):
        assert got[k][:-1] == [f"Title {k}", f"Body {k} of page {k}, long enough.", *([f"More {k}"] if k % 3 else [])]
        assert got[k][-1].startswith(f"A kept text of page {k}.")
    # One page alone is no evidence: only what names and tags say goes.
    assert got[101][0] == "Your daily paper" and "Offer 1" in got[101]
    # Without the tree the frame stays, and the branch with a bad name goes.
    alone = html_extract.Page(framed(1)).text().split("\n")
    assert "Your daily paper" in alone and "Terms" in alone and not any(x.startswith("A kept") for x in alone)


def test_style_tree_equals_a_recursion(spark):
    from math import log

    sources = [framed(k) for k in range(9)] + ["<p>x</p>", "", None, "<div><p>x<p>y</div>"]
    nodes: dict = {}
    for source in sources:
        for b in html_extract.branches(html_extract.Page(source))[0]:
            x = nodes.setdefault(b.key, {"parent": b.parent, "styles": {}, "texts": {}, "chars": 0, "leaf": b.texts is not None})
            x["styles"][b.style] = x["styles"].get(b.style, 0) + 1
            x["chars"] += b.chars
            for t in b.texts or ():
                x["texts"][t] = x["texts"].get(t, 0) + 1

    def raw(key):
        x = nodes[key]
        m, said = sum(x["styles"].values()), sum(x["texts"].values())
        if x["leaf"]:
            value = 1 - (sum(n * log(n) for n in x["texts"].values()) / (said * log(m)) if m > 1 else 0)
            return value, 1 / m + (1 - 1 / m) * value
        kids = [(k, *raw(k)) for k, y in nodes.items() if y["parent"] == key]
        below = sum((nodes[k]["chars"] + 1) * r for k, r, _ in kids) / sum(nodes[k]["chars"] + 1 for k, _, _ in kids)
        own = (log(m) - sum(n * log(n) for n in x["styles"].values()) / m) / log(m) if m > 1 else 1.0
        share = html_extract.GAMMA ** len(x["styles"])
        value = (1 - share) * own + share * below
        return value, max([1 / m + (1 - 1 / m) * value, *[b for _, _, b in kids]])

    pages = spark.createDataFrame([(k, "http://h.org", x) for k, x in enumerate(sources)], "page_id long, url string, html string")
    found = {r.key: r for r in html_extract.style_tree(pages).collect()}
    assert set(found) == set(nodes)
    for key, r in found.items():
        value, best = raw(key)
        m = sum(nodes[key]["styles"].values())
        assert r.pages == m and r.importance == pytest.approx(1 / m + (1 - 1 / m) * value) and r.best == pytest.approx(best)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div class='article has-sidebar'><p>a</p></div>", "a"),
        ("<section class='social-history'>a</section><p class='form'>b</p>", "a\nb"),
        ("<p>foo <span class='ad'>x</span> bar</p><div id=sidebar>no</div>", "foo bar"),
        ('<p>One <svg class="i"/> two</p><p>three</p>', "One two\nthree"),
        ("<p>One <svg class=i><title>Icon<g/></title><style/><path d='M1'/><text>label</text>\n</svg> two<p>three", "One two\nthree"),
        ("<p>One <svg><style/><circle></svg> two <svg><path> lost<p>three</p>", "One two\nthree"),
        ("<title-x>One</title-x><style-guide><p>two</p></style-guide><object-card>three</object-card>", "One\ntwo\nthree"),
        ("<p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> then <math/>so</p>", "If x=2 then so"),
        ("<p>a <object data=x><param name=y><p>inner</p></object> b <canvas>drawn</canvas> c</p>", "a\ninner\nb drawn c"),
        ("<p>a <noscript><div>no</div></noscript>b <template><p>no<li>no</template>c</p>d", "a b c\nd"),
        ("<head><title>T</title><script>'</p><svg>'</script ><STYLE>p > a {}</STYLE></head><p>a<textarea><p>no</textarea>b<iframe src=x />c<xmp/>d", "abcd"),
        ("<p>a<script src=x />b<p>c", "ab\nc"),
        ("a<script>b<p>c", "a"),
    ],
)
def test_only_raw_text_elements_take_all_up_to_their_end(source, text):
    assert html_extract.Page(source).text() == text


# Chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|im|>user\n", "\\l\\e \\", "", None, "é[<\\", "<|im|>"]
    rows = [(c, t, role, text) for c, text in enumerate(odd) for t, role in enumerate(("user", "assistant"))] + [(99, 0, "assistant", "x"), (99, 0, "assistant", "x"), (98, None, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got: dict = {}
    for r in sorted(chat.read_chat(chat.format_chat(df)).collect(), key=lambda r: (r.conv_id, r.at)):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.loss))
    for c, text in enumerate(odd):
        assert got[c] == [("user", text or "", ""), ("assistant", text or "", text or "")]
    assert got[99] == [("assistant", "x", "x")] * 2 and got[98] == [("", "y", "")]
    plan = chat.digests(chat.format_chat(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_layouts_are_known_by_their_field_paths(spark):
    rows = [
        (1, '{"prompt": "a", "completion": "b"}'), (2, '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}'),
        (3, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}'), (4, '{"x": 1}'), (5, "no json"), (6, None), (7, '{"instruction": "a", "input": "i", "output": "b"}'),
    ]
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.turns_from_json(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect()}
    ab = [("user", "a"), ("assistant", "b")]
    assert got == {1: ab, 2: ab, 3: ab, 4: None, 5: None, 6: None, 7: [("user", "a\n\ni"), ("assistant", "b")]}


def test_layouts_with_further_fields_and_empty_lists_keep_their_turns(spark):
    a, b = ("user", "a"), ("assistant", "b")
    cases = [
        ('{"messages": []}', []), ('{"id": 7, "conversations": [], "tags": ["x"]}', []), ('{"messages": [null]}', None), ('{"messages": null}', None), ('{"messages": [3]}', None),
        ('{"id": 7, "prompt": "a", "meta": {"k": [1]}, "completion": "b"}', [a, b]), ('{"response": "b", "prompt": "a", "system": "s", "id": 1}', [("system", "s"), a, b]),
        ('{"id": 7, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b", "w": {"role": 1}}, null]}', [a, b, (None, None)]),
        ('{"prompt": "a", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [a, b]), ('{"messages": [], "prompt": "a", "completion": "b"}', [a, b]),
        ('{"messages": [{"role": "user", "content": ["a"]}]}', None), ('{"prompt": ["a"], "completion": "b", "id": 1}', None), ('{"role": "user", "text": "a"}', [a]), ("[]", None), ('"x"', None),
    ]
    rows = spark.createDataFrame([(i, payload) for i, (payload, _) in enumerate(cases)], "id long, payload string")
    got = {r.conv_id: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat.turns_from_json(rows, "id", "payload").collect()}
    assert got == {i: turns for i, (_, turns) in enumerate(cases)}


def test_typed_tables_are_mapped_by_their_fingerprint(spark):
    rows = spark.sql("SELECT 1L AS conv_id, 'a' AS prompt, 'b' AS completion")
    assert [tuple(r) for r in chat.turn_rows(rows).orderBy("turn").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    turns = spark.sql("SELECT 1L AS conv_id, 5L AS turn, 'x' AS text, CAST(NULL AS STRING) AS role")
    assert [tuple(r) for r in chat.turn_rows(turns).collect()] == [(1, 5, None, "x")]
    turn = chat.Layout("turn", "role string, text string", "array(named_struct('role', upper(role), 'text', text))")
    assert chat.turn_rows(spark.sql("SELECT 1L AS conv_id, 5L AS turn, 'x' AS text, 'user' AS role"), (turn,)).first().role == "USER"
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(spark.sql("SELECT 1L AS conv_id, 5L AS turn, 'x' AS other"))


# Packing


def test_packing_covers_every_id_once_and_piece_tables_agree(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [None, "", "Don't  STOP_it's 12½ naïve — Ünïcode x", "ﬁne ǅ İstanbul ß", "<|endoftext|> a", " ".join(words(rng, 900)), "日本 語\ttab", "a" * 3000]
    texts += ["don't 'tis 'S \"'s ''s 's's 'st 'll've x'", "'", "'t", "a'\nre're 'r e'", "_a_b 1234 é'é", " \n a ", "a' s'"]
    texts += ["".join(rng.choices("ab'strelvmd 1_-\né", k=rng.randrange(60))) for _ in range(400)]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]

    def agrees(coder):
        ids, n = coder.encode(pa.array(texts, pa.string()), 1)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]

    monkeypatch.setattr(packing, "LONG", 2)
    coder = packing.WordTokenizer(path)
    for most in (1 << 20, 0):
        monkeypatch.setattr(packing, "TABLE_BYTES", most)
        agrees(coder)
        agrees(coder)
    # Different pieces of one hash: the tokenizer takes the texts whole.
    keys = packing.piece_keys
    monkeypatch.setattr(packing, "piece_keys", lambda *a: (keys(*a)[0] * 0, keys(*a)[1]))
    agrees(coder)
    monkeypatch.setattr(packing, "piece_keys", keys)
    monkeypatch.setattr(packing, "SLICE_BYTES", 500)
    assert max(map(len, packing._parts(" ".join(["word"] * 500)))) <= 504 and "".join(packing._parts(texts[5])) == texts[5]
    rows = [(k, t) for k, t in enumerate(texts)]
    pieces = packing.pack(frame(spark, rows).repartition(3), path, window=64).collect()
    want = dict(enumerate(want))
    seen: dict = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == seen.get(p.doc_id, 0) and p.doc_tokens == len(want[p.doc_id]) and p.offset + p.length <= 64
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id] = p.start + p.length
    assert seen == {k: len(v) for k, v in want.items()}
    by: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert sorted(by) == list(range(len(by))) and all(by[s] == 64 for s in sorted(by)[:-1])
    assert packing.pack(frame(spark, []), path).count() == 0


# Pipeline


def test_pipeline_stages_keep_the_columns_and_clean_documents(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.7 * before
        docs = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
