"""Spelling variants: automata, near words, chains and the noise against brute force; groups larger than a block."""

import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import spelling as S


def near(p, w):
    if len(p) == len(w):
        return sum(x != y for x, y in zip(p, w)) == 1
    if abs(len(p) - len(w)) != 1:
        return False
    s, t = sorted((p, w), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts):
    forms, rows = {}, {}
    for p, n in counts.items():
        others = [(-counts[w], w) for w in counts if near(p, w)]
        best = min(others, default=None)
        forms[p] = best[1] if best and -best[0] >= 2 * n else None
        rows[p] = (n, len(others))
    out = []
    for p in counts:
        root = p
        while forms[root]:
            root = forms[root]
        out.append((p, forms[p], root, *rows[p], counts[forms[p]] if forms[p] else None))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def words_of(seed, n, letters="abé", longest=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(5, longest))) for _ in range(n)})


def test_automaton_is_minimal_and_numbers_its_words():
    words = words_of(3, 300)
    a = S.Automaton(words)
    reached = {}
    for k, w in enumerate(words):
        at = (np.zeros(1, np.int64), np.full(1, a.root), np.zeros(1, np.int64))
        for c in w:
            at = a.step(at, np.array([ord(c)]))
        assert a.final[at[1][0]] and at[2][0] == k
    tails = lambda p: frozenset(w[len(p) :] for w in words if w.startswith(p))
    for w in words:
        for k in range(len(w) + 1):
            reached[tails(w[:k])] = True
    assert len(a.final) == len(reached)  # as many states as different sets of endings
    assert len(S.Automaton([]).final) == 1


@pytest.mark.parametrize("block, chunk", [(20_000, 60_000), (7, 20), (1, 3)])
def test_near_words_and_chains(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    r = random.Random(block)
    counts = {w: r.choice([3, 3, 4, 6, 12, 50, 200]) for w in words_of(block, 250) + ["aaaaa" + "b" * 40, "aaaaa" + "b" * 41]}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    near_rows = {w.word: (w.n_near, w.best_n, w.best) for w in S.near_words(df, block).collect()}
    want = {}
    for p in counts:
        others = sorted((-counts[w], w) for w in counts if near(p, w))
        if others:
            want[p] = (len(others), -others[0][0], others[0][1])
    assert near_rows == want
    if block != 7:
        assert rows_of(S.variants(df)) == brute(counts)


def noisy(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_whole_operator(spark):
    r = random.Random(9)
    words = words_of(5, 60, "abcÉé") + ["Word", "WORDS", "wordy"]
    rows = [(r.choice([None, *range(90)]), " ".join(r.choice(words) for _ in range(40))) for _ in range(90)] + [(1, None), (2, ""), (3, "1 2 ."), (4, "x" * 3000 + " " + "x" * 3000), (4, "x" * 3000)]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int")
    counts = noisy(rows)
    assert len(counts) > 50
    assert rows_of(S.spelling_variants(docs)) == brute(counts)


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_of_many_links(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(60)] + [("other", "w030")]
    got = {r.word: r.root for r in S.chain_ends(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(got.values()) == {"w060"} and len(got) == 61
