"""Parsers of model output."""

import json

import pytest

from factloom.functions import parsers as P
from factloom.functions.text import cut_bytes, escape_like, tail_bytes

A = dict(scope_confidence=0.8, confidence=0.9, entity=None, category="fact", scope="project", content="uses tabs")
B = {**A, "content": 'says "no" [sometimes] {really}', "entity": "tone"}
one, two = json.dumps(A), json.dumps(B)


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("  []\n", []),
        (f"[{one},{two}]", [A, B]),
        (f"```json\n[{one}]\n```", [A]),
        (f"Sure! Here is the list:\n[{one}] Anything else?", [A]),
        (f"[{one}]\n\n[{two}]", [A, B]),
        (f"[{one}] {{", [A]),
        (one, [A]),
        (f"{one}\n{two}", [A, B]),
        (f"[{one},{two},{{\"content\": \"cut o", [A, B]),
        (f"[{one[1:]},{two}", [B]),
        ("[" + one[1:] + "]", [A]),
        (None, []),
    ],
)
def test_candidates(text, want):
    assert P.parse_candidates(text) == want


def test_candidate_defaults():
    got = P.parse_candidates('[{"scope": "personal", "content": "c", "category": "fact"}]')
    assert got == [dict(entity=None, confidence=0.5, scope_confidence=0.5, content="c", scope="personal", category="fact")]


@pytest.mark.parametrize("text", ["no json here", '{"a": 1}', "[1, 2", '[{"content": 3}]'])
def test_unparseable(text):
    with pytest.raises(P.Unparseable):
        P.parse_candidates(text)


def actions(text, n):
    return [d["action"] + (f":{d['target']}" if d["target"] is not None else "") for d in P.parse_decisions(text, n)]


def test_decisions():
    plain = '[{"reason": "passing", "action": "drop", "index": 0}, {"action": "merge:0", "index": 2}, {"action": "keep_as_project", "index": 1}]'
    assert actions(plain, 3) == ["drop", "keep_as_project", "merge:0"]
    assert actions("<think>[maybe]</think>" + plain, 3) == actions(plain, 3) == actions(f"```\n{plain}\n```", 3) == actions(f"Here: {plain}.", 3)
    assert actions('[{"index": 1, "action": "drop"}]', 3) == ["keep", "drop", "keep"]
    assert actions('[{"index": 7, "action": "drop"}, {"index": 0, "action": "ponder"}]', 1) == ["keep"]
    assert actions('[{"index": 0, "action": "drop"}, {"index": 0, "action": "keep"}]', 1) == ["drop"]
    assert actions('[{"action": "merge:x", "index": 0}, {"action": "drop", "index": 1}]', 2) == ["keep", "keep"]
    assert actions('[{"index": "0", "action": "drop"}]', 1) == actions("garbage", 1) == actions(None, 1) == ["keep"]
    assert P.parse_decisions("garbage", 0) == []


def test_synthesis():
    assert P.parse_synthesis('{"content": "x"}') == {"content": "x", "category": "pattern", "confidence": 0.8}
    assert P.parse_synthesis('<think>a</think>```json\n{"content": "x", "category": "fact", "confidence": 1}\n```') == {"content": "x", "category": "fact", "confidence": 1.0}
    assert P.parse_synthesis('It is {"content": "x"} indeed')["content"] == "x"
    with pytest.raises(P.Unparseable):
        P.parse_synthesis("nothing")


def test_pieces_and_fences():
    assert P.objects('{"a":"}"},{"b":{"c":1}} tail {"d"') == ['{"a":"}"}', '{"b":{"c":1}}', '{"d"']
    assert P.unfence("```json\nx\n```") == "x" and P.unfence("a") == "a" and P.unfence("```x```") == "x"
    assert P.after_think("a</think> b ") == "b" and P.after_think("<think>a") == "<think>a"


def test_byte_cuts():
    assert cut_bytes("é—x", 2) == "é" and cut_bytes("é—x", 4) == "é" and cut_bytes("é—x", 5) == "é—" and cut_bytes("ab", 9) == "ab"
    assert tail_bytes("é—x", 3) == "x" and tail_bytes("é—x", 4) == "—x" and tail_bytes("ab", 2) == "ab"
    assert escape_like(r"5%_\x") == r"5\%\_\\x"
