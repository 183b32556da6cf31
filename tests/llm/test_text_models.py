"""Toxicity and language identification: held-out accuracy on small invented corpora, and the defined cases."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np

from cueframe.llm import langid, toxicity

ALPHABETS = {"aa": ["the", "ing", "an", "ou", "er", "th"], "bb": ["eau", "le", "que", "é", "oi", "ai"], "cc": ["sch", "und", "ü", "ge", "ei", "ver"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    rows = [(k, speech(rng, lang, rng.randint(6, 60)), lang) for k, lang in enumerate(rng.choices(list(ALPHABETS), k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    right = [got[d].lang_pred == lang for d, _, lang in rows if d % 4 == 2]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    rng = random.Random(2)
    rows = [(k, speech(rng, "aa", 30), "aa") for k in range(12)] + [(50, speech(rng, "bb", 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = [(1, None), (2, ""), (3, "12 34 -- !!"), (4, "the " * 50_000), (5, "the"), (5, "the"), (6, "." * 900 + " the")]
    got = [tuple(r)[:2] for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang_pred", langid.F.lit(1)), model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "aa"), (5, "aa"), (6, "aa")]
    none = langid.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def corpus(n=500):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["aa", "cc"])
        text = speech(rng, lang, rng.randint(10, 80))
        toxic = int(rng.random() < 0.2)
        if toxic:
            bad = rng.choice(["idiot", "scum", "pathetic"]) if lang == "aa" else "qualk" + rng.choice(["ei", "ge", "und"])
            at = rng.randint(0, len(text))
            text = text[:at] + f" {bad} " * rng.randint(1, 3) + text[at:]
        rows.append((k, text))
        labels.append((k, toxic))
    return rows, labels


def test_toxic_texts_are_found_in_either_language(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.where(~toxicity.held_out()), known.where(~toxicity.held_out()))
    assert any(s.startswith("qualk"[:4]) for s in model.voters.stems)
    got = {r.doc_id: r.c_score for r in toxicity.score_texts(docs, model).where(toxicity.held_out()).collect()}
    truth = dict(labels)
    assert np.mean([(s >= 0.5) == bool(truth[d]) for d, s in got.items()]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score_texts(docs, model).where("c_score < 0.5").collect()}


def test_toxicity_of_odd_texts_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "you are an idiot and a moron", 3), (3, "you are an idiot and a moron", 3), (4, "calm " * 40_000, 4)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_texts(docs, model)
    assert out.columns == ["doc_id", "text", "x", "c_score"]
    scores = {}
    for r in out.collect():
        scores.setdefault(r.doc_id, set()).add(r.c_score)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in scores.values())
    assert scores[1] == scores[2]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_every_stem_over_the_thresholds_is_mined(spark):
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrst", repeat=3), 5000)]
    docs = spark.createDataFrame([(k, " ".join(words) if k < 8 else "plain words") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(20)], "doc_id long, toxic int")
    assert [s for s, _, _ in toxicity.mine(docs, labels)] == [f"{w} " for w in words]


def test_a_stem_begins_words_and_a_word_stands_alone():
    voters = toxicity.voters_from([("qual", 9, True), ("grob ", 8, True)])
    machine = voters.matcher()
    fired = lambda t: dict(zip(voters.names, toxicity.counts(voters, machine, t), strict=False))
    assert fired("Qualtier xqual grob grober")["qual"] == 1
    assert fired("Qualtier xqual grob grober")["grob "] == 1


def test_correlated_voters_count_as_one(spark):
    fired = lambda *bits: np.packbits(np.array([bits], bool), axis=1).tobytes()
    v = 3 + len(toxicity.PATTERNS)
    zero = (0,) * len(toxicity.PATTERNS)
    rows = [(fired(1, 1, 0, *zero), 60, 1), (fired(0, 0, 1, *zero), 60, 1), (fired(0, 0, 0, *zero), 60, 1), (fired(0, 0, 0, *zero), 900, 0)]
    patterns = spark.createDataFrame(rows, "fired binary, n long, known int")
    model = toxicity.fit_label_model(patterns, v, toxicity.LabelModel(np.full(v, 0.2), np.full(v, 0.01), 0.1, np.ones(v)))
    assert model.weight[0] < 0.6 and model.weight[1] < 0.6 and model.weight[2] > 0.9


def many_tongues(n=1500):
    """Toxic words are one stem a language with a suffix that rarely comes twice; one language calls a listed insult a plain word."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(list(ALPHABETS))
        words = speech(rng, lang, rng.randint(20, 60)).split()
        toxic = int(rng.random() < 0.15)
        if toxic:
            stem = {"aa": "zwick", "bb": "pflop", "cc": "gnarz"}[lang]
            words.insert(rng.randint(0, len(words)), stem + "".join(rng.choices("aeioubdfgklmnprst", k=5)))
        if lang == "bb" and rng.random() < 0.3:
            words += ["vile"] * rng.randint(1, 30)
        rows.append((k, " ".join(words), toxic))
        labels.append((k, toxic if k % 5 < 2 else None))
    return rows, labels


def test_stems_are_found_whatever_follows_them(spark):
    rows, labels = many_tongues()
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    model = toxicity.fit(docs.where(~toxicity.held_out()), spark.createDataFrame(labels, "doc_id long, toxic int").where(~toxicity.held_out()))
    assert {"zwic", "pflo", "gnar"} <= set(model.voters.stems)
    assert "vile " not in model.voters.stems
    got = [(r.truth, r.c_score >= 0.5) for r in toxicity.score_texts(docs.where(toxicity.held_out()), model).collect()]
    assert np.mean([p for t, p in got if t]) > 0.95
    assert np.mean([p for t, p in got if not t]) < 0.01


def test_words_that_fall_into_toxic_texts_by_chance_or_with_a_commoner_stem_are_not_mined(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    rows, labels = [], []
    for k in range(800):
        text = rng.sample(words, 30)
        toxic = k % 2
        if toxic:
            text.append("qualk" + rng.choice("aeiou"))
        # Copies of one toxic text: their own words are in toxic texts alone.
        rows.append((k, "qualka " + " ".join(f"zz{w}" for w in words[:20]) if toxic and k < 60 else " ".join(text)))
        labels.append((k, toxic))
    stems = toxicity.mine(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [s for s, _, _ in stems] == ["qual"]


def test_chance_bounds_the_share_of_blind_draws():
    for hits, n, toxic, total in [(8, 8, 8, 20), (5, 9, 20, 100), (3, 4, 10, 50), (2, 30, 3, 90)]:
        ways = sum(math.comb(toxic, x) * math.comb(total - toxic, n - x) for x in range(hits, min(n, toxic) + 1))
        exact = ways / math.comb(total, n)
        assert exact <= toxicity.chance(hits, n, toxic, total) * (1 + 1e-9) <= 2 * exact
    assert toxicity.chance(2, 10, 20, 100) == 1
    assert toxicity.chance(8, 8, 20, 20) == 1
