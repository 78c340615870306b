"""The secret automaton against Python's expressions: all kinds, every rule alone, texts made of the rules' own pieces."""

import re

import numpy as np
import pytest

from plumbline.llm import secrets


def brute(rule, doc):
    """Spans of one rule by ``re`` over the bytes: leftmost, non-overlapping, greedy, with what the rule says of short runs."""
    if not rule.tail:
        return [m.span() for m in re.finditer(rule.head.encode(), doc)]
    if rule.consumes:
        found = re.finditer(f"{rule.head}({rule.tail}+)".encode(), doc, rule.flags)
        return [m.span() for m in found if len(m[1]) >= rule.least]
    return [m.span() for m in re.finditer(f"{rule.head}{rule.tail}{{{rule.least},}}".encode(), doc, rule.flags)]


PIECES = "password PassWD secret token api_key apikey = : ' \" \x20 \x20\x20 AKIA ABCD1234 0123456789abcdef deadbeef ghp_ gho_ xoxb- xoxp- eyJ abcdefgh ABCDEFGHIJKLMNOP . , - _ == \n é 😀 -----BEGIN PRIVATE\x20KEY----- RSA".split(" ")
PIECES += [" ", "  ", "-----BEGIN RSA PRIVATE KEY-----", "x" * 30, "eyJabcdefgh.ijklmnopq"]


@pytest.mark.parametrize("rules", [secrets.RULES, *[(r,) for r in secrets.RULES]], ids=lambda rs: "+".join(r.kind for r in rs))
def test_spans_match_the_expressions(rules):
    rng = np.random.default_rng(len(rules))
    auto = secrets.compile_rules(rules)
    texts = ["".join(rng.choice(PIECES, rng.integers(0, 14))) for _ in range(4000)] + ["".join(rng.choice(PIECES, 4000)), None, ""]
    got = secrets.spans_of(auto, texts, rules)
    for t, spans in zip(texts, got):
        doc = (t or "").encode()
        want = sorted((len(doc[:a].decode()), k, len(doc[:b].decode())) for k, r in enumerate(rules) for a, b in brute(r, doc))
        assert spans == want, t


def test_segments_end_only_where_every_state_is_the_start():
    for rules in ((secrets.RULES[5],), secrets.RULES):
        text = "w" * 516 + "eyJabcdefghijk.abcdefghijklmnop" + "w" * 600
        k = [r.kind for r in rules].index("jwt")
        assert (516, k, 516 + 31 + 600) in secrets.spans_of(secrets.compile_rules(rules), [text], rules)[0]


def test_automaton_is_minimal_and_small():
    auto = secrets.compile_rules()
    assert auto.n_states < 1000 and auto.flags[0] == 0 and (auto.flags[auto.first_flag // auto.n_classes :] > 0).all()
    rows = np.column_stack([auto.flags, auto.move.reshape(auto.n_states, -1)])
    assert len(np.unique(rows, axis=0)) == auto.n_states


def test_long_runs_take_linear_time():
    text = "0123456789abcdef" * 20_000 + " token=" + "a" * 200_000 + " xoxb-" * 20_000
    spans = secrets.spans_of(secrets.compile_rules(), [text])[0]
    assert [s for s in spans if s[1] == 2][0] == (0, 2, 320_000)


def test_long_texts_without_resets_are_cut_into_lanes(monkeypatch):
    """A megabyte of words and spaces is scanned in lanes, and lanes that begin with a wrong guess run again: equal results for any length."""
    import random
    import time

    r = random.Random(3)
    auto = secrets.compile_rules()
    prose = " ".join(r.choice(["password", "is", "the", "AKIA", "token", "ab12", "of"]) for _ in range(180_000))
    began = time.monotonic()
    secrets.spans_of(auto, [prose])
    assert time.monotonic() - began < 2
    pieces = ["password", " ", " " * 40, "=", ":", '"', "AKIA", "0123456789abcdef", "token", "zzzzzzzzzzzz", ".", "\n", "é", "A" * 20]
    for _ in range(60):
        texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 200))) for _ in range(3)]
        monkeypatch.setattr(secrets, "SEGMENT", 512)
        want = secrets.spans_of(auto, texts)
        monkeypatch.setattr(secrets, "SEGMENT", r.randint(1, 9))
        assert secrets.spans_of(auto, texts) == want
