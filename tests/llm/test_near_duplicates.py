"""The near-duplicate stage right at its bar, on texts that are longer than their sketches."""

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import simhash


def pairs_of(kinds, words=600):
    """Texts 2 i and 2 i + 1 share all but the last kinds[i] words; of 5-word shingles all those before are common."""
    out = []
    for i, k in enumerate(kinds):
        base = [f"p{i}w{j}" for j in range(words)]
        out += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: words - k] + [f"p{i}x{j}" for j in range(k)]))]
    return out


def test_pairs_at_the_bar_are_decided_exactly(spark):
    """530 of 662 shingles in common (0.8006) make a link, 529 of 663 (0.7979) don't."""
    d = spark.createDataFrame(pairs_of([66] * 40 + [67] * 40), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(d).collect())
    assert kept == [*range(0, 80, 2), *range(80, 160)]


def nodes_of(spark, texts, fp=None, views=None):
    p = simhash._profiles(5).func(pd.Series(texts))
    rows = [(int(d), int(f) if fp is None else fp, [None if v is None else int(v) for v in vs] if views is None else views, bytearray(s)) for f, vs, s, d, _ in p.itertuples(index=False)]
    whole = [(int(d), bytearray(np.unique(simhash.shingle_hashes(t, 5)).tobytes())) for d, t in zip(p.digest, texts)]
    sets = spark.createDataFrame(whole, "digest bigint, whole binary")
    nodes = spark.createDataFrame(rows, "digest bigint, fp bigint, views array<bigint>, sketch binary")
    return nodes, lambda digests: sets.join(digests, "digest"), {int(g): i for i, g in enumerate(p.digest)}


def groups_of(found, at):
    groups = {}
    for r in found.collect():
        groups.setdefault(r.component, []).append(at[r.node])
    return sorted(sorted(g) for g in groups.values())


def test_blocks_decide_exactly_too(spark, monkeypatch):
    """No hubs that help: one bucket holds all texts, and each has its pair at the bar in it."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    texts = dict(pairs_of([66] * 30 + [67] * 30))
    nodes, wholes, at = nodes_of(spark, [texts[i] for i in sorted(texts)], 7, [7])
    assert groups_of(simhash.similar_components(nodes, 0.8, wholes), at) == [[2 * i, 2 * i + 1] for i in range(30)]
    with pytest.raises(ValueError):
        simhash.similar_components(nodes, 0.8)


def test_a_shared_passage_makes_no_block_of_all(spark, monkeypatch):
    """Texts that share a passage are in one bucket, but only similar ones share a rare hash."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    passage = [f"s{j}" for j in range(150)]
    texts = []
    for i in range(60):
        own = [f"t{i}w{j}" for j in range(250)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-3] + ["x", "y", "z"])]
    nodes, wholes, at = nodes_of(spark, texts, 7, [7])
    labels = spark.createDataFrame([], "node bigint, component bigint")
    buckets = nodes.selectExpr("digest", "0 AS view", "CAST(7 AS BIGINT) AS print")
    blocks = simhash._open_blocks(buckets, labels, nodes, 0.8)
    met = blocks.alias("x").join(blocks.alias("y"), ["view", "print", "sub"]).where("x.digest < y.digest").selectExpr("x.digest a", "y.digest b").distinct().count()
    assert 60 <= met < 400  # of 7140 pairs
    assert groups_of(simhash.similar_components(nodes, 0.8, wholes), at) == [[2 * i, 2 * i + 1] for i in range(60)]


def test_hashes_of_one_text_make_no_rows(spark, monkeypatch):
    """Texts that have but a passage in common: rows for the few hashes of prefixes that two texts have, not for all."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    passage, texts = [f"s{j}" for j in range(150)], []
    for i in range(30):
        own = [f"t{i}w{j}" for j in range(250)]
        texts += [" ".join(passage + own), " ".join(passage + [f"u{i}x{j}" for j in range(250)])]
    nodes, wholes, at = nodes_of(spark, texts, 7, [7])
    rows, written = {}, simhash.materialize

    def counted(df, label, **how):
        out = written(df, label, **how)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    buckets = nodes.selectExpr("digest", "0 AS view", "CAST(7 AS BIGINT) AS print")
    simhash._open_blocks(buckets, spark.createDataFrame([], "node bigint, component bigint"), nodes, 0.8).count()
    assert rows["wide"] == len(texts) and "hashes" not in rows
    assert rows["rare"] < 5 * len(texts)  # 50 a text before


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_prefixes_share_a_hash_of_similar_sketches(similarity):
    rng = np.random.default_rng(1)
    for _ in range(2000):
        size = int(rng.integers(1, 160))
        x = rng.choice(10**6, size, replace=False)
        y = np.unique(np.r_[rng.choice(x, max(1, int(size * rng.uniform(similarity, 1))), replace=False), rng.choice(10**6, rng.integers(0, 30))])
        a, b = (np.sort(v)[: simhash.SKETCH].astype("<u4").tobytes() for v in (x, y))
        if simhash.sketch_verdict(a, b, similarity):
            order = rng.permutation(10**6)
            heads = []
            for v in (a, b):
                v = np.frombuffer(v, "<u4")
                heads.append(set(v[np.argsort(order[v])][: simhash.prefix_size(len(v), similarity)]))
            assert heads[0] & heads[1]


def test_verdicts_of_a_block_match_one_by_one():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(400, rng.integers(0, 300), replace=False)) for _ in range(40)]
    sets += [np.sort(rng.choice(s, int(0.9 * len(s)), replace=False)) for s in sets]
    sketches = [s[: simhash.SKETCH].astype("<u4").tobytes() for s in sets]
    values, codes, sizes = simhash._coded(sketches)
    place, every = np.zeros(len(values) + 1, np.int64), np.arange(len(sets))
    for x in every:
        got = simhash._verdicts(x, every, codes, sizes, place, 0.8)
        assert got.tolist() == [simhash.sketch_verdict(sketches[x], s, 0.8) for s in sketches]
    assert not place.any()


def test_dense_clusters_near_the_bar_are_decided_in_blocks(spark, monkeypatch):
    """A family of texts, all pairs near the bar: half of it in groups that are over it."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    common = [f"c{j}" for j in range(420)]
    texts = []
    for i in range(40):
        own = [f"f{i // 2 if i < 20 else i}w{j}" for j in range(100)]
        texts.append(" ".join(common + own[:80] + [f"z{i}v{j}" for j in range(20)]))
    nodes, wholes, at = nodes_of(spark, texts, 7, [7])
    found = []
    dense = simhash._dense
    monkeypatch.setattr(simhash, "_dense", lambda pairs: found.append(dense(pairs)) or found[-1])
    want = [[2 * i, 2 * i + 1] for i in range(10)]
    assert groups_of(simhash.similar_components(nodes, 0.8, wholes), at) == want
    assert any(d is not None for d in found)


@pytest.mark.parametrize("passed", [0, 4])
def test_dense_blocks_pass_a_forest(spark, monkeypatch, passed):
    """Many undecided pairs in a block: a forest of them goes out, no more than its texts, and every pair is still decided."""
    monkeypatch.setattr(simhash, "PASSED", passed)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    common = [f"c{j}" for j in range(420)]
    texts = []
    for i in range(40):
        own = [f"f{i // 2 if i < 20 else i}w{j}" for j in range(100)]
        texts.append(" ".join(common + own[:80] + [f"z{i}v{j}" for j in range(20)]))
    nodes, wholes, at = nodes_of(spark, texts, 7, [7])
    buckets = nodes.selectExpr("digest", "0 AS view", "CAST(7 AS BIGINT) AS print")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    dealt = simhash._open_blocks(buckets, labels, nodes, 0.8).repartition(*simhash._DEAL).sortWithinPartitions(*simhash._DEAL)
    met = dealt.mapInPandas(simhash._joined(0.8), simhash._JOINED).where("a IS NOT NULL").collect()
    assert len(met) < 40 and all(r.dense for r in met)
    assert groups_of(simhash.similar_components(nodes, 0.8, wholes), at) == [[2 * i, 2 * i + 1] for i in range(10)]


def test_a_forest_joins_what_its_pairs_join():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pairs = [tuple(int(v) for v in p) for p in rng.integers(0, 30, (int(rng.integers(0, 80)), 2))]
        forest = simhash._forest(pairs)

        def parts(edges):
            of = list(range(30))
            for a, b in edges:
                of = [of[a] if x == of[b] else x for x in of]
            return [[x == y for x in of] for y in of]

        assert parts(forest) == parts(pairs) and len(forest) < 30 and set(forest) <= set(pairs)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_streamed_sides_of_a_block_pair(batch):
    """Held sets against streamed ones and, once, against each other; links give the components of all similar pairs."""
    rng = np.random.default_rng(batch)
    base = [np.sort(rng.choice(10**6, 50, replace=False)).astype(np.uint64) for _ in range(6)]
    sets = [np.sort(np.r_[b[: 50 - k], rng.choice(10**6, k, replace=False).astype(np.uint64) + np.uint64(10**6)]) for b in base for k in (0, 2, 4)]
    place = rng.integers(0, 3, len(sets))
    rows = []
    for low in range(3):
        for high in range(low + 1, 3):
            rows += [(0, 7, low * (1 << 31) + high, i, bool(place[i] == low), s.tobytes()) for i, s in enumerate(sets) if place[i] in (low, high)]
    f = pd.DataFrame(rows, columns=["view", "print", "sub", "label", "first", "whole"]).sort_values(["view", "print", "sub", "first"], ascending=[True, True, True, False], kind="stable")
    links = pd.concat(simhash._exact_in_blocks(0.8)(iter([f[k : k + batch] for k in range(0, len(f), batch)])))
    group = list(range(len(sets)))
    for a, b in zip(links.src, links.dst):
        group = [group[a] if g == group[b] else g for g in group]
    in_pair = lambda i, j: place[i] != place[j] or place[i] < 2  # noqa: E731  the last block is never held
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n >= 0.8 * (100 - n) and in_pair(i, j):
                want = [want[i] if g == want[j] else g for g in want]
    same = lambda x: [[p == q for p in x] for q in x]
    assert same(group) == same(want) and len(set(group)) < len(sets)


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "text_digests", lambda t: (5, hash(tuple(simhash.words_of(t))) & (2**62 - 1)))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["one text", "two texts", "One  TEXT", "three", None, " "])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(d).collect()) == [0, 1, 3, 4]


def test_recall_on_a_whole_table(spark):
    """Every pair of sf0.01 with a Jaccard similarity of 0.8 or more, found by brute force over an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    lists = {}
    for i, x in sets.items():
        for h in x:
            lists.setdefault(h, []).append(i)
    common = {}
    for ids in lists.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] = common.get((ids[b], ids[a]), 0) + 1
    true = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    lost = [(a, b) for a, b in true if a in kept and b in kept]
    assert len(true) > 50 and len(lost) <= 0.01 * len(true), lost
    partners = {}
    for a, b in true:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    empty = [i for i, x in sets.items() if not x]
    assert all(i in partners or i in empty for i in sets if i not in kept)


def test_sketches_reject_and_accept_only_far_from_the_bar():
    low, high = simhash.sketch_bounds(0.8)
    assert low < 0.65 * simhash.SKETCH and high > 0.94 * simhash.SKETCH
    rng = np.random.default_rng(5)
    hits = rng.binomial(simhash.SKETCH, 0.8, 100_000)
    assert ((hits >= low) & (hits < high)).all()
