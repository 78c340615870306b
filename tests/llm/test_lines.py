"""Line dedup: the whole operator against brute force, split keys, bitmaps of long texts, plans without Python."""

import hashlib
import random

import pytest

from plumbline.llm import line_dedup as L

SCHEMA = "doc_id bigint, text string, keep string, th string, o string"


def brute(rows):
    """(id, n_lines, n_dropped, kept text) of each row."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: L.FIRST if i is None else i
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(order(i), first.get(key(line), order(i)))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def rows_of(seed, n):
    r = random.Random(seed)
    pool = [f"a line of its own kind {k}" for k in range(40)] + ["Hot line of many", "short", "", "  ", "\tÄÖ hot line of many \r", "hot LINE of many", "ten chars!", "nine char"]
    return [(r.choice([None, 1, 2, *range(10, 10 + n)]), "\n".join(r.choice(pool) for _ in range(r.randint(1, 200 if r.random() < 0.1 else 12)))) for _ in range(n)]


EDGES = [(5, None), (6, ""), (7, "\n"), (8, "Only once in here\nOnly once in here"), (9, "only ONCE in here \nonly"), (9, "only ONCE in here \nonly"), (None, "only once in here"), (-3, "x" * 100000 + "\nHot line of many")]


@pytest.mark.parametrize("sampled", [64, 10_000])
def test_whole_operator(spark, monkeypatch, sampled):
    monkeypatch.setattr(L, "SAMPLED", sampled)
    rows = rows_of(sampled, 150) + EDGES
    docs = spark.createDataFrame([(*r, "k", "t", "o") for r in rows], SCHEMA).repartition(5)
    got = L.without_repeated_lines(docs)
    assert {"th", "o"} <= set(got.columns)
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in got.collect()) == brute(rows)


def test_hot_keys_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLED", 10_000)
    docs = spark.createDataFrame([(i, f"the same line\nanother line {i}") for i in range(400)], "doc_id long, text string")
    lines = L.hashed_lines(docs)
    hot = L._hot_keys(lines, 4).collect()
    assert len(hot) == 1 and hot[0].m >= 50 and hot[0].known == 0
    assert L.repeated_lines(lines, 4).count() == 399


def test_bitmaps_of_long_texts(spark):
    """Only words with a dropped line have an entry, wherever they are."""
    text = "\n".join(f"line number {k}" for k in range(1000))
    docs = spark.createDataFrame([(1, "line number 3\nline number 700\nline number 764"), (2, text)], "doc_id long, text string")
    (row,) = L.keep_bitmaps(docs).collect()
    assert [e.word for e in row.keep] == [0, 10, 11] and row.n_dropped == 3
    got = {r.doc_id: r.kept for r in L.without_repeated_lines(docs).collect()}
    want = "\n".join(f"line number {k}" for k in range(1000) if k not in (3, 700, 764))
    assert hashlib.sha256(got[2].encode()).hexdigest() == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    d = L.without_repeated_lines(docs)
    assert d.count() == 0
    lines = L.hashed_lines(spark.createDataFrame([(1, "a line that is long")], "doc_id long, text string"))
    plan = L.repeated_lines(lines, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "rangepartitioning" in plan
    assert plan.split("Window")[1].count("hashpartitioning(h") <= 2  # the window reads the ranges as they are; only the join deals
