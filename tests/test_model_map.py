"""Chunked maps: what was done is not asked again, calls in flight are bounded, replies are read strictly."""

from __future__ import annotations

import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from cueframe.operators import model_map
from cueframe.operators.model_map import Correction, Translation


# Tasks cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def segments(spark, n, key=1):
    return spark.createDataFrame([(key, i, f"t{i}" if i != 1 else None) for i in range(n)], "key long, idx long, text string")


class Logged(model_map.Answering):
    """Writes the texts of each call down, and fails for chunks that hold ``bad``."""

    def __init__(self, path, bad=None):
        super().__init__("x")
        self.path, self.bad = str(path), bad

    def __call__(self, asked):
        texts = [s["text"] for s in json.loads(asked)["segments"]]
        with open(self.path, "a") as file:
            file.write(json.dumps(texts) + "\n")
        if self.bad in texts:
            raise RuntimeError("down")
        return super().__call__(asked)

    def calls(self):
        with open(self.path) as file:
            return sorted(json.loads(line) for line in file)


def test_a_second_run_asks_only_for_the_failed_chunk(spark, tmp_path):
    rows, request = segments(spark, 4), Translation("en", "zh")
    first = Logged(tmp_path / "first", bad="t3")
    with pytest.raises(ValueError, match=r"2 rows .* 1/2\. Last error: RuntimeError: down"):
        model_map.mapped(rows, request, first, str(tmp_path / "map"), 2, rounds=0)
    assert first.calls() == [["t0", ""], ["t2", "t3"]]
    second = Logged(tmp_path / "second")
    got = {r.idx: r.text for r in model_map.mapped(rows, request, second, str(tmp_path / "map"), 2).collect()}
    assert got == {0: "[x] t0", 1: "", 2: "[x] t2", 3: "t3"} and second.calls() == [["t2", "t3"]]
    third = Logged(tmp_path / "third")
    assert model_map.mapped(rows, request, third, str(tmp_path / "map"), 2).count() == 4 and not (tmp_path / "third").exists()
    for other, changed in ((Translation("en", "de"), rows), (request, segments(spark, 5)), (request, rows.selectExpr("key", "idx", "concat(text, '!') AS text"))):
        again = Logged(tmp_path / f"other{id(changed)}{other.target_lang}")
        model_map.mapped(changed, other, again, str(tmp_path / "map"), 2).collect()
        assert len(again.calls()) >= 2


def test_missing_rows_are_asked_for_alone(spark, tmp_path):
    client = Logged(tmp_path / "calls", bad="t2")
    with pytest.raises(ValueError, match="1 rows .* 1/2"):
        model_map.mapped(segments(spark, 4), Translation("en", "zh"), client, str(tmp_path / "map"), 4, rounds=1)
    assert client.calls() == [[""], ["t0"], ["t0", "", "t2", "t3"], ["t2"], ["t3"]]


def test_odd_checkpoints_are_passed_over(spark, tmp_path):
    rows, request = segments(spark, 2), Translation("en", "zh")
    mark = model_map.marks(rows, request).first()
    folder = tmp_path / "map" / "chunks" / "aa"
    folder.mkdir(parents=True)
    line = {"key": 1, "fingerprint": mark.fingerprint, "total": 2, "idx": 0, "text": "kept"}
    odd = [json.dumps(line)] * 2 + ["{cut", "[]", json.dumps(line | {"idx": 9}), json.dumps(line | {"idx": 1, "total": 3}), json.dumps(line | {"idx": 1, "text": None}), json.dumps(line | {"idx": 1, "fingerprint": "other"})]
    (folder / "a.json").write_text("\n".join(odd))
    (folder / "_b.json").write_text(json.dumps(line | {"idx": 1, "text": "half written"}))
    client = Logged(tmp_path / "calls")
    assert {r.idx: r.text for r in model_map.mapped(rows, request, client, str(tmp_path / "map"), 1).collect()} == {0: "kept", 1: "[x] "}
    assert client.calls() == [[""]]


def test_halving_asks_four_two_two():
    sizes = []

    def client(asked):
        said = json.loads(asked)["segments"]
        sizes.append(len(said))
        return json.dumps([{"index": s["index"], "text": s["text"].upper()} for s in said][: 3 if len(said) == 4 else 9])

    rows = [{"idx": k, "text": f"t{k}"} for k in range(4)]
    assert [t for t, _, _ in model_map.asked(client, Translation("en", "zh"), rows)] == ["T0", "T1", "T2", "T3"] and sizes == [4, 2, 2]
    with pytest.raises(ValueError):
        model_map.asked(lambda _: "[]", Translation("en", "zh"), rows)


def test_calls_in_flight_are_bounded_and_in_order():
    now, most, lock = 0, 0, threading.Lock()

    def work(k):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 if k % 3 else 0.05)
        with lock:
            now -= 1
        return k

    assert list(model_map.in_order(range(20), work, 3)) == list(range(20)) and most == 3
    begun = []

    def failing(k):
        begun.append(k)
        if k == 2:
            raise RuntimeError("second")
        time.sleep(0.01)
        return k

    with pytest.raises(RuntimeError, match="second"):
        list(model_map.in_order(range(1000), failing, 2))
    assert len(begun) < 10


@pytest.mark.parametrize("reply", ["{}", "[1]", '[{"index": 1, "text": "a"}]', '[{"index": 0, "text": 5}]', '[{"index": 0}]', '[{"index": false, "text": "a"}]', '[{"index": 0, "text": "a"}] x', "[]"])
def test_wrong_replies(reply):
    with pytest.raises(ValueError):
        model_map.indexed(reply, 1)
    assert model_map.indexed("[]", 0) == []


def test_correction_message_and_reply():
    request = Correction("en", domain_context="law", threshold=0.5, rules=({"source": "a", "target": "b"},))
    words = [{"text": "a", "start": 0.0, "end": None, "confidence": 0.2}, {"text": "b", "start": None, "end": 1.0, "confidence": None}]
    asked = json.loads(request.ask([{"idx": 7, "text": "a b", "start": 0.0, "end": 1.0, "confidence": 0.4, "words": words}]))
    low = {"text": "a", "start": 0.0, "confidence": 0.2}
    assert asked["segments"] == [{"index": 0, "start": 0.0, "end": 1.0, "text": "a b", "confidence": 0.4, "words": [low, {"text": "b", "end": 1.0}], "low_confidence_words": [low], "below_uncertainty_threshold": True}]
    assert (asked["domain_context"], asked["glossary_rules"]) == ("law", [{"source": "a", "target": "b"}])
    rows = [{"text": "a"}, {"text": "b"}, {"text": "c"}]
    reply = [{"index": 0, "text": "a"}, {"index": 1, "text": "B"}, {"index": 2, "text": "c", "status": "uncertain", "uncertain_reason": "noise"}]
    assert request.read(json.dumps(reply), rows) == [("a", "unchanged", None), ("B", "corrected", None), ("c", "uncertain", "noise")]
    for wrong in ({"status": "odd"}, {"uncertain_reason": 7}):
        with pytest.raises(ValueError):
            request.read(json.dumps([reply[0] | wrong, *reply[1:]]), rows)
