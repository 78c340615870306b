"""The digest index: memtables, levels, filter, several flushes, digests that collide, runs too large to broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup as E

SCHEMA = "doc_id bigint, text string"


def groups(rows):
    """Brute force: (doc_id, keep_id, group_size, kept) of each row."""
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = by[norm(t)]
        low = min((x for x in ids if x is not None), default=None)
        out.append((i, low, len(ids), i == low))
    return sorted(map(str, out))


ROWS = [(i, f"text {i % 7}\t x") for i in range(60)] + [(100 + i, f"alone {i}") for i in range(40)] + [(None, "text 1  x"), (None, None), (500, ""), (501, None), (501, None)]


def result(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in df.collect())


@pytest.mark.parametrize("memtable, broadcast", [(1 << 20, True), (3, True), (3, False)])
def test_groups(spark, monkeypatch, memtable, broadcast):
    monkeypatch.setattr(E, "MEMTABLE_ROWS", memtable)
    if not broadcast:
        monkeypatch.setattr(E, "small", lambda df: df)
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("x")).withColumn("salt", F.lit("y"))
    assert result(E.dedup_groups(docs.repartition(5))) == groups(ROWS)


def test_colliding_digests_are_split_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *cols: F.lit(-7).cast("bigint"))
    assert result(E.dedup_groups(spark.createDataFrame(ROWS, SCHEMA))) == groups(ROWS)


def test_levels_keep_smallest_ids_over_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(E, "MEMTABLE_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(int(d), int(i)) for d, i in zip(rng.integers(-30, 30, 600), rng.permutation(600))]
    index = E.MergeIndex()
    for k in range(9):
        index.flush(spark.createDataFrame(rows[k::9], "digest bigint, doc_id bigint"))
    assert [len(level) for level in index.levels] == [1, 2]  # two merges of four tables, and the ninth
    got = {r.digest: (r.min_id, r.n) for r in index.entries().collect()}
    want = {}
    for d, i in rows:
        low, n = want.get(d, (i, 0))
        want[d] = (min(low, i), n + 1)
    assert got == want
    index.flush(spark.createDataFrame([(5, -1), (99, 4)], "digest bigint, doc_id bigint"))
    later = {r.digest: r.min_id for r in index.entries().collect()}
    assert later[5] == -1 and later[99] == 4 and len(later) == len({*want, 5, 99})


def test_filter_passes_all_members_and_few_others(spark):
    run = spark.range(5000).select(F.xxhash64("id").alias("digest"))
    held = E.DigestFilter(run)
    assert run.where(held.may_hold(F.col("digest"))).count() == 5000
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("digest"))
    assert others.where(held.may_hold(F.col("digest"))).count() < 0.03 * 20_000
    empty = E.DigestFilter(run.limit(0))
    assert run.where(empty.may_hold(F.col("digest"))).count() == 0


def test_empty_table(spark):
    assert E.dedup_groups(spark.createDataFrame([], SCHEMA)).count() == 0
