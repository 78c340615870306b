"""The log-bilinear scores against direct sums, on other partitionings, and on workers that lack the package."""

import math
import os
import re
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm_score as M

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def toy(n=40, seed=0):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 500, n))[::-1]
    mass = np.r_[0, 7, 50, counts].astype(float)
    return {"tokens": int(mass.sum()), "types": n + 1, "starts": M.class_starts(counts), "mass": mass, "rare_mass": 9.0, "hashes": np.zeros(0, np.int64), "counts": np.zeros(0, np.int64), "codes": np.zeros(0, np.int32)}


def brute_log_prob(m, u, v, w):
    h = [m.r[u][i] * m.c[0][i] + m.r[v][i] * m.c[1][i] for i in range(M.DIM)]
    dot = lambda x, y: sum(float(a) * float(b) for a, b in zip(x, y))
    outer = [dot(h, a) + float(d) for a, d in zip(m.a, m.d)]
    k = next(j for j in range(len(m.starts) - 1) if m.starts[j] <= w < m.starts[j + 1])
    before = len(m.starts) - 1 if v == M.BEGIN else next(j for j in range(len(m.starts) - 1) if m.starts[j] <= v < m.starts[j + 1])
    inner = {x: dot(m.s[before], m.q[x]) + float(m.b[x]) for x in range(m.starts[k], m.starts[k + 1])}
    lse = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    return outer[k] - lse(outer) + inner[w] - lse(list(inner.values()))


def test_model_is_normalised_learns_and_matches_direct_sums(monkeypatch):
    monkeypatch.setattr(M, "CLASSES", 9)
    vocab = toy()
    n = len(vocab["mass"])
    rng = np.random.default_rng(3)
    step = rng.permutation(np.arange(3, n))
    w = np.concatenate([np.r_[step[(np.arange(6) + k) % len(step)], M.END] for k in rng.integers(0, len(step), 3000)])
    ends = np.arange(7, len(w) + 1, 7)
    start = M.LogBilinear.start(vocab)
    trainer = M.Trainer(vocab, start.vector(), 1)
    for _ in range(6):
        trainer.texts(w, ends)
    u, v = M.contexts_of(w, ends)
    means = []
    for m in (start, trainer.m):
        norms = m.inner_norms()
        for a, b in ((0, 0), (0, 5), (7, 30), (2, n - 1)):
            every = np.arange(1, n)
            assert np.exp(m.log_probs(np.full(n - 1, a), np.full(n - 1, b), every, norms)).sum() == pytest.approx(1, abs=1e-4)
        got = m.log_probs(u[:50], v[:50], w[:50], norms)
        assert got == pytest.approx([brute_log_prob(m, *x) for x in zip(u[:50], v[:50], w[:50])], abs=1e-4)
        means.append(m.log_probs(u, v, w, norms).mean())
    assert means[1] > means[0] + 1.0


def test_contexts_begin_with_each_text():
    u, v = M.contexts_of(np.array([5, 6, 2, 2, 7, 2]), np.array([3, 4, 6]))
    assert u.tolist() == [0, 0, 5, 0, 0, 0] and v.tolist() == [0, 5, 6, 0, 0, 7]


def test_scores_match_brute_force_and_not_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 5_000)
    monkeypatch.setattr(M, "CHUNK", 2_000)
    monkeypatch.setattr(M, "FAN", 2)
    monkeypatch.setattr(M, "HEAD_WORDS", 3_000)
    monkeypatch.setattr(M, "WORDS", 2_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "never seen w0rds"), (None, "the of")], "doc_id bigint, text string"))
    runs = [{r.doc_id: r.score for r in M.score_documents(docs.repartition(n)).collect()} for n in (1, 4, 16)]
    for other in runs[1:]:  # texts share matrix products, whose rounding depends on the texts beside them
        assert other == pytest.approx(runs[0], rel=1e-7)
    rows, counts, _, vocab, flat = M.fit(docs)
    m, tally = M.LogBilinear(vocab, flat), {r.h: r.c for r in counts.collect()}
    norms = m.inner_norms()
    import xxhash

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows.where("n_tokens < 400").collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").encode().lower())
        h = [int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)) for w in words] + [M.END_HASH]
        code = [int(c) for c in M.look_up(vocab, np.array(h))[1]]
        total, before = 0.0, [M.BEGIN, M.BEGIN]
        for x, w in zip(h, code):
            total += float(m.log_probs(np.array(before[-2:-1]), np.array(before[-1:]), np.array([w]), norms)[0]) / math.log(10)
            if w == M.RARE:
                total += math.log10((tally.get(x, 0) + 1) / vocab["rare_mass"])
            before.append(w)
        assert runs[0][r.doc_id] == pytest.approx(total, rel=1e-5)


def test_workers_need_no_package(tmp_path):
    """The package is on the driver's path only: workers are processes of their own, and must import nothing from it."""
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import os, sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        sys.path.insert(0, {REPO!r})
        from plumbline.llm import queries
        for name in ("op2_markov_url_filter", "op7_automaton_secrets", "op8_log_bilinear_score"):
            print("ROWS", queries.QUERIES[name](spark, {SF!r}).count())
        spark.stop()
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ROWS") == 3, done.stderr[-3000:]


def test_head_words_have_codes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, _, _, vocab, _ = M.fit(docs)
    share = rows.agg((F.sum("n_rare") / F.sum("n_tokens")).alias("x")).first().x
    assert share < 0.2 and len(vocab["mass"]) > 10_000
