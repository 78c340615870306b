"""The score buffer: append, sample, save and read; samples equal on any partitioning and mergeable."""

import pytest

from plumbline.operators.buffers import ScoreBuffer, hashed_sample


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_buffer(spark, tmp_path):
    b = ScoreBuffer()
    assert b.is_empty() and "a" not in b
    with pytest.raises(ValueError):
        b.rows()
    first = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("a", 3.0, 3)], "key string, score double, rank int")
    b.append(first).append(first.select("rank", "score", "key"))
    assert rows(b.get("a")) == [("a", 1.0, 1)] * 2 + [("a", 3.0, 3)] * 2 and "b" in b and "c" not in b
    assert rows(b.keys()) == [("a",), ("b",)] and not b.is_empty()
    for bad in (first.drop("key"), first.drop("score")):
        with pytest.raises(ValueError):
            b.append(bad)
    with pytest.raises(KeyError):
        b.get("c")
    b.save(str(tmp_path / "saved"))
    again = ScoreBuffer.read(spark, str(tmp_path / "saved"))
    assert rows(again.rows().select("key", "score", "rank")) == rows(b.rows())
    assert b.clear().is_empty()


def test_samples(spark):
    """One key holds most rows; the sample follows from the rows alone, and that of a union from those of its parts."""
    df = spark.range(3000).selectExpr("IF(id % 10 = 0, id % 7, -1) AS key", "id", "id * 1.5 AS part", "'x' AS h")
    want = rows(hashed_sample(df, "key", 20, seed=3))
    assert len(want) == 8 * 20
    assert rows(hashed_sample(df.repartition(9), "key", 20, seed=3, parts=4)) == want != rows(hashed_sample(df, "key", 20, seed=4))
    halves = [hashed_sample(df.where(f"id % 2 = {k}"), "key", 20, seed=3) for k in (0, 1)]
    assert rows(hashed_sample(halves[0].unionByName(halves[1]), "key", 20, seed=3)) == want
    assert rows(hashed_sample(spark.createDataFrame([("a", 1)] * 5, "key string, v int"), "key", 3)) == [("a", 1)] * 3
    heads = [rows(hashed_sample(df, "key", 1, seed=s))[0][1] for s in range(12)]
    assert len(set(heads)) > 6
