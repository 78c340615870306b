"""Phrase growth: the whole operator against brute force, borders of batches, exact scores, ties."""

import random
import re
from collections import Counter

import pandas as pd
import pytest

from plumbline.llm import collocation as C

SCHEMA = "doc_id long, text string, lang string, a string, phrase string, n string"


def brute(rows, fewest, first=2000):
    """(lang, rank, phrase, a, l, r, n, score)."""
    f = {}
    for lang, text in rows:
        mine = f.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                mine.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, mine in f.items():
        many = {p: a for p, a in mine.items() if len(p) > 1 and a >= fewest}
        total = sum(a for p, a in mine.items() if len(p) == 1)
        kept = []
        for p, a in many.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in many.items()):
                continue
            score, k = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def result(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def rows_of(seed, n=120):
    r = random.Random(seed)
    words = ["The", "of", "a", "İx", "ß", "new", "york", "time\x85s", "\x1c", "z\xa0z"]
    gaps = [" "] * 12 + ["\t ", ". ", ",", "\n", "!?", "\x0b", "\r\n"]
    text = lambda k: "".join(r.choice(words) + r.choice(gaps) for _ in range(k)) + "new york times of old "
    return [(r.choice([None, "und", "en", "en", "de"]), text(r.randint(1, 60))) for _ in range(n)] + [("en", None), ("xx", ""), ("xx", " \t."), ("en", "far " * 2000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(k, text, lang, "a", "p", "n") for k, (lang, text) in enumerate(rows)], SCHEMA).repartition(4)


@pytest.mark.parametrize("fewest, bits, size, records", [(30, 20, 4_000_000, 10_000), (5, 16, 300, 3)])
def test_whole_operator(spark, monkeypatch, fewest, bits, size, records):
    """Also with so few counters that nothing is pruned, texts split one by one, and batches of three contexts."""
    monkeypatch.setattr(C, "LEAST_BITS", bits)
    monkeypatch.setattr(C, "MOST_BITS", bits)
    monkeypatch.setattr(C, "HELD_WORDS", size)
    monkeypatch.setattr(C, "HELD_COUNTERS", size)
    monkeypatch.setattr(C, "BYTES", size)
    rows = rows_of(fewest)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = result(C.collocations(docs_of(spark, rows), fewest=fewest))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows, fewest) and len(got) >= 5


def test_first_phrases_only(spark):
    rows = rows_of(2)
    assert result(C.collocations(docs_of(spark, rows), fewest=3, first=7)) == brute(rows, 3, 7)


def test_growth_adds_up_over_borders():
    """Runs below the bar end inside of a batch; at its borders they go on, whatever the batches are."""
    rows = [("en", "a", "b", "c", None, 4), ("en", "a", "b", "d", None, 1), ("en", "a", "x", None, None, 1), ("en", "b", "c", None, None, 5), ("fr", "b", "c", None, None, 5)]
    f = pd.DataFrame(rows, columns=["lang", "w1", "w2", "w3", "w4", "c"])
    for cut in range(6):
        got = Counter()
        for part in C.grown(iter([f[:cut], f[cut:]]), 5, 4):
            for r in part.itertuples():
                got[r.lang, r.phrase] += r.f
        assert {k: v for k, v in got.items() if v >= 5} == {("en", "a b"): 5, ("en", "b c"): 5, ("fr", "b c"): 5}
    assert ("en", "a x") not in {(r.lang, r.phrase) for part in C.grown(iter([f]), 5, 4) for r in part.itertuples()}


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    (row,) = C.scored(words, phrases).collect()
    assert row.score == 2_000_000 * (big - 7) // (2 * big + 1)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
