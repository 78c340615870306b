"""Streams that stop and start again: state in versions gives what one pass over all batches gives."""

import numpy as np
import pytest

from plumbline.operators import centers, losses
from plumbline.streaming import streams
from plumbline.streaming.state import Versions

SCHEMA = "id long, features array<double>, label int"


def batches_of(seed, n=5, size=30, classes=3, dim=4):
    """Batches of rows (id, features, label); the last class comes late, and one class is missing now and then."""
    r, out, at = np.random.default_rng(seed), [], 0
    for b in range(n):
        rows = []
        for _ in range(size):
            k = int(r.integers(0, classes - (b < 2)))
            if b == 3 and k == 0:
                k = 1
            rows.append((at, [float(v) for v in 100 + k + r.normal(size=dim)], k if r.random() < 0.9 else -1))
            at += 1
        out.append(rows)
    return out


@pytest.fixture
def source(spark, tmp_path):
    """Files that come one by one, and the stream over them."""

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return put, stream, tmp_path


def running(batches, dim=4, classes=3):
    run = centers.RunningCenters(classes, dim)
    for rows in batches:
        known = [(f, k) for _, f, k in rows if k >= 0]
        mu = np.full((classes, dim), np.nan)
        for c in range(classes):
            own = [f for f, k in known if k == c]
            if own:
                mu[c] = np.mean(own, axis=0)
        run._fold(mu)
    return run.centers


def test_running_centers_restart(spark, source):
    put, stream, tmp = source
    batches = batches_of(1)
    for k, rows in enumerate(batches):  # every start is a new query on the same checkpoint
        put(rows)
        streams.running_center_stream(stream(), str(tmp / "state"), str(tmp / "check")).awaitTermination(60)
        got = {r.label: r.center for r in streams.centers_of(spark, str(tmp / "state")).collect()}
        want = running(batches[: k + 1])
        assert set(got) == {c for c in range(3) if not np.isnan(want[c]).any()}
        assert all(np.allclose(got[c], want[c]) for c in got)
    assert Versions(spark, str(tmp / "state")).numbers() == [3, 4]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    batches = [spark.createDataFrame(b, SCHEMA) for b in batches_of(2, n=3)]
    v = Versions(spark, str(tmp_path / "state"))
    for k, batch in enumerate(batches):
        for _ in range(2):
            v.put(k, streams.folded_centers(batch, v.before(k)))
    (tmp_path / "state/v9").mkdir()  # a version that was begun and not finished
    assert v.numbers() == [1, 2]
    got = {r.label: r.center for r in streams.centers_of(spark, str(tmp_path / "state")).collect()}
    want = running(batches_of(2, n=3))
    assert all(np.allclose(got[c], want[c]) for c in got)
    with pytest.raises(ValueError):
        streams.centers_of(spark, str(tmp_path / "nothing"))


def test_virtual_outliers_follow_the_queues(spark, source):
    """After each batch: the synthesis from the last rows a class of all rows so far, also over a restart and once classes change."""
    put, stream, tmp = source
    seen, batches = [], batches_of(3, n=4)
    for rows in batches:
        put(rows)
        streams.virtual_outlier_stream(stream(), lambda d: seen.append(sorted(map(tuple, d.collect()))), str(tmp / "state"), str(tmp / "check"), n=12, sample_from=50, select=2, seed=7).awaitTermination(90)
    assert len(seen) == 4
    for k in range(4):
        rows = spark.createDataFrame([r for b in batches[: k + 1] for r in b], SCHEMA).where("label >= 0")
        want = centers.virtual_outliers(centers.last_rows(rows, "label", "id", 12), sample_from=50, select=2, seed=7)
        want = sorted(map(tuple, want.collect()))
        assert [w[:2] for w in want] == [s[:2] for s in seen[k]]
        assert np.allclose([w[2] for w in want], [s[2] for s in seen[k]], rtol=1e-9)


def test_multipliers_restart(spark, source):
    put, stream, tmp = source
    batches = batches_of(4, n=3)
    plain = losses.EnergyMarginLoss(0.5)
    how = {"rate": 0.5}
    for rows in batches:
        put(rows)
        fresh = losses.EnergyMarginLoss(0.5)  # a new process begins with these; the versions hold what was reached
        streams.multiplier_stream(stream(), fresh, str(tmp / "state"), str(tmp / "check"), logits="features", weight=0.01, bias=0.1, how=how).awaitTermination(60)
        plain.step(spark.createDataFrame(rows, SCHEMA), "features", "label", weight=0.01, bias=0.1, **how)
        got = [r for _, *v in sorted(map(tuple, Versions(spark, str(tmp / "state")).latest().collect())) for r in v]
        assert got == pytest.approx([plain.alarms.multiplier, plain.alarms.penalty, plain.fit.multiplier, plain.fit.penalty])
    assert plain.alarms.multiplier > 0
