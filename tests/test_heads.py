"""Heads of any size and depth: every detector with weights at 1,000 x 2,048, gradients, dropout, agreement with the small forms."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import heads as H
from plumbline.functions import scores as S
from plumbline.functions import vectors as V
from plumbline.operators.centers import ClassCenters
from plumbline.operators.classwise import KNN, SHE, KLMatching, OpenMax
from plumbline.operators.detectors import ASH, DICE, MCD, ODIN, MaxSoftmax, ReAct
from plumbline.operators.gaussian import RMD, Mahalanobis, MultiMahalanobis, ViM

SCHEMA = "id long, features array<double>, label int"


def rows_of(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(k, [float(v) for v in row], int(c)) for k, (row, c) in enumerate(zip(x, y))] + [(len(x), None, 0)], SCHEMA)


def scores(df):
    got = {r.id: r.score for r in df.select("id", "score").collect()}
    last = got.pop(max(got))
    assert last is None  # null features
    return np.array([got[k] for k in sorted(got)])


R = np.random.default_rng(4)
X, W, B = R.normal(size=(30, 12)), R.normal(size=(5, 12)), R.normal(size=5)
Y = (X @ W.T + B).argmax(1)
Y[-4:] = -1
SMALL = {
    "ash-s": lambda: ASH(weights=W, bias=B, variant="ash-s"),
    "ash-b": lambda: ASH(weights=W, bias=B, variant="ash-b", percentile=0.9),
    "ash-p": lambda: ASH(weights=W, bias=B, variant="ash-p", detector=S.max_logit),
    "ash-all": lambda: ASH(weights=W, bias=B, variant="ash-p", percentile=1.0),
    "react": lambda: ReAct(weights=W, bias=B, threshold=0.5),
    "dice": lambda: DICE(weights=W, bias=B, p=60),
    "odin": lambda: ODIN(weights=W, bias=B, eps=0.1, norm_std=np.linspace(0.5, 2, 12)),
    "mcd-var": lambda: MCD(weights=W, bias=B, samples=7),
    "mcd-mean": lambda: MCD(weights=W, bias=B, samples=3, mode="mean", dropout=0.2),
    "she": lambda: SHE(weights=W, bias=B),
}


@pytest.mark.parametrize("name", SMALL)
def test_batches_equal_expressions(spark, monkeypatch, name):
    df = rows_of(spark, np.where(R.random(X.shape) < 0.1, 0.25, X), Y)
    df = df.withColumn("label", F.when(F.col("features").isNull(), -1).otherwise(F.col("label")))
    if name == "she":
        df = rows_of(spark, X, Y).withColumn("label", F.when(F.col("features").isNull(), -1).otherwise(F.col("label")))
    expected = scores(SMALL[name]().fit_features(df).predict_features(df))
    monkeypatch.setattr(V, "MAX_LITERALS", 1)
    assert scores(SMALL[name]().fit_features(df).predict_features(df)) == pytest.approx(expected, rel=1e-9, abs=1e-12)


def test_tables_of_classes_in_batches(spark, monkeypatch):
    df = rows_of(spark, X, Y).withColumnRenamed("features", "logits").where("logits IS NOT NULL")
    table = {k: np.full(12, 1 / 12) + (np.arange(12) == k) for k in range(12)}
    kl = KLMatching(lambda d: d)
    kl.table, kl.fitted = table, True
    values = lambda d: [r.score for r in d.orderBy("id").collect()]
    expected = values(kl.predict(df))
    far = [r[0] for r in df.orderBy("id").select(ClassCenters(W).distances("logits")).collect()]
    monkeypatch.setattr(V, "MAX_LITERALS", 1)
    assert values(kl.predict(df)) == pytest.approx(expected, rel=1e-9)
    assert np.allclose([r[0] for r in df.orderBy("id").select(ClassCenters(W).distances("logits")).collect()], far)
    kl.table = {0: np.ones(12) / 12}
    with pytest.raises(Exception, match="no fitted rows of class"):
        kl.predict(df).collect()


def deep_head(dropout=False):
    r = np.random.default_rng(8)
    norm = H.BatchNorm(r.normal(size=10), r.random(10) + 0.5, r.random(10) + 0.5, r.normal(size=10))
    layers = [H.Linear(r.normal(size=(10, 10)), r.normal(size=10)), norm, H.Tanh(), H.Linear(r.normal(size=(8, 10)), r.normal(size=8)), H.Relu()]
    return H.Head([*layers, *([H.Dropout(0.5)] if dropout else []), H.Linear(r.normal(size=(3, 8)), r.normal(size=3))])


def numeric(f, x, h=1e-6):
    return np.stack([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(x.shape[1])], axis=1)


def test_gradients_against_finite_differences():
    head, x = deep_head(), np.random.default_rng(1).normal(size=(20, 10))
    best = head.forward(x).argmax(1)
    rows = np.arange(len(x))
    assert np.allclose(head.winner_gradient(x), numeric(lambda z: head.forward(z)[rows, best], x), atol=1e-6)
    label = np.arange(20) % 3
    loss = lambda z: -np.log(H.softmax(head.forward(z) / 4)[rows, label])
    assert np.allclose(head.likelihood_gradient(x, label, 4.0), numeric(loss, x), atol=1e-6)


def test_odin_and_mahalanobis_through_layers(spark):
    head, x = deep_head(), np.random.default_rng(2).normal(size=(40, 10))
    y = head.forward(x).argmax(1)
    df = rows_of(spark, x, y)
    gradient = numeric(lambda z: head.forward(z)[np.arange(len(x)), y], x)
    moved = x + 0.01 * np.sign(gradient)
    expected = -H.softmax(head.forward(moved)).max(1)
    assert scores(ODIN(head=head, eps=0.01).predict_features(df)) == pytest.approx(expected, rel=1e-6)
    given = (y + 1) % 3
    other = numeric(lambda z: head.forward(z)[np.arange(len(x)), given], x)
    pushed = -H.softmax(head.forward(x + 0.01 * np.sign(other))).max(1)
    wide = df.join(spark.createDataFrame([(k, int(c)) for k, c in enumerate(given)], "id long, c int"), "id", "left")
    assert scores(ODIN(head=head, eps=0.01, target="c").predict_features(wide)) == pytest.approx(pushed, rel=1e-6)

    det = Mahalanobis(head=head, eps=0.02).fit_features(df)
    e = head.forward(x)
    assert np.allclose(det.means, [e[y == k].mean(0) for k in det.classes])
    far = lambda z: np.stack([np.einsum("ij,jk,ik->i", z - m, det.precision, z - m) for m in det.means], 1)
    near = far(e).argmin(1)
    gradient = numeric(lambda z: far(head.forward(z))[np.arange(len(x)), near], x)
    expected = far(head.forward(x - 0.02 * np.sign(gradient))).min(1) / 2
    assert scores(det.predict_features(df)) == pytest.approx(expected, rel=1e-6)
    assert len(scores(RMD(head=head).fit_features(df).predict_features(df))) == 40


def test_dropout_passes(spark):
    """Masks are those of the expression; scores don't depend on batches, and the mean over many passes nears the head's output."""
    head = deep_head(dropout=True)
    df = rows_of(spark, np.random.default_rng(3).normal(size=(25, 10)))
    one = scores(MCD(head=head, samples=5).predict_features(df.repartition(1)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert scores(MCD(head=head, samples=5).predict_features(df.repartition(6))) == pytest.approx(one, rel=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    x = np.ones((1, 8))
    last = H.Head(head.layers[-2:])
    mean, spread = last.passes(x, np.array([77]), 4000)
    draws = np.random.default_rng(0).random((4000, 8)) < 0.5
    p = H.softmax(np.where(draws, 0, 2.0) @ np.asarray(head.layers[-1].weights).T + head.layers[-1].bias)
    assert np.allclose(mean, p.mean(0), atol=0.02) and np.allclose(spread / 3999, p.var(0), atol=0.02)
    (row,) = df.where("id = 3").select(F.array(*[V.unit_hash(F.col("id"), F.lit(2), F.lit(d)) for d in range(4)]), F.xxhash64("id")).collect()
    h = H.hash_int(np.arange(4)[None, :], H.hash_int(np.array([[2]]), np.array([[row[1]]]).view(np.uint64)))
    assert H.unit_interval(h)[0] == pytest.approx(row[0], rel=1e-15)


WIDE = {
    "ash-s": lambda w, b: ASH(weights=w, bias=b),
    "ash-b": lambda w, b: ASH(weights=w, bias=b, variant="ash-b"),
    "ash-p": lambda w, b: ASH(weights=w, bias=b, variant="ash-p"),
    "react": lambda w, b: ReAct(weights=w, bias=b),
    "dice": lambda w, b: DICE(weights=w, bias=b),
    "odin": lambda w, b: ODIN(weights=w, bias=b),
    "mcd": lambda w, b: MCD(weights=w, bias=b, samples=30),
    "vim": lambda w, b: ViM(d=1000, weights=w, bias=b),
}


@pytest.fixture(scope="module")
def wide(spark):
    r = np.random.default_rng(5)
    w = r.normal(size=(1000, 2048)) / 45
    x = r.normal(size=(24, 2048))
    return w, r.normal(size=1000), x, rows_of(spark, x).where("features IS NOT NULL").persist()


@pytest.mark.parametrize("name", WIDE)
def test_wide_heads(wide, name):
    w, b, x, df = wide
    began = time.monotonic()
    got = [r.score for r in WIDE[name](w, b).fit_features(df).predict_features(df).orderBy("id").select("score").collect()]
    assert len(got) == 24 and all(s is not None and np.isfinite(s) for s in got)
    assert time.monotonic() - began < 60
    if name == "react":
        z = np.minimum(x, 1) @ w.T + b
        m = z.max(1)
        assert got == pytest.approx(-(m + np.log(np.exp(z - m[:, None]).sum(1))), rel=1e-9)


def test_wide_tables(spark, wide):
    """Tables of 1,000 classes: SHE, KL matching, centre distances and their scores."""
    w, b, x, df = wide
    began = time.monotonic()
    she = SHE(weights=w, bias=b)
    she.table, she.fitted = dict(enumerate(w)), True
    got = [r.score for r in she.predict_features(df).orderBy("id").collect()]
    assert got == pytest.approx(-(x * w[(x @ w.T + b).argmax(1)]).sum(1), rel=1e-9)
    kl = KLMatching()
    kl.table, kl.fitted = {k: np.full(2048, 1 / 2048) for k in range(2048)}, True
    p = df.withColumn("probabilities", H.batched("array<double>", H.softmax)(F.col("features")))
    assert all(r.score > 0 for r in kl.predict_features(p).collect())
    far = df.orderBy("id").select(ClassCenters(w).distances("features")).first()[0]
    assert far == pytest.approx(np.linalg.norm(x[0] - w, axis=1), rel=1e-9)
    assert time.monotonic() - began < 90


def test_null_vectors(spark):
    df = rows_of(spark, X, np.arange(30) % 3)
    assert len(scores(KNN().fit_features(df).predict_features(df))) == 30
    d = df.withColumnRenamed("features", "logits")
    assert len(scores(OpenMax(tailsize=5, alpha=3).fit_features(d).predict_features(d))) == 30
    assert len(scores(MaxSoftmax().predict_features(d))) == 30


def test_feature_maps_of_several_layers(spark):
    """Maps of 3 channels of 16 x 16 and of 5 channels, beside a vector, in two passes for all: as separate fits of channel means."""
    r = np.random.default_rng(11)
    maps, deep, flat, y = r.normal(size=(60, 3, 256)), r.normal(size=(60, 5, 4)), r.normal(size=(60, 4)), np.arange(60) % 3
    rows = [(k, maps[k].tolist(), deep[k].tolist(), flat[k].tolist(), int(y[k])) for k in range(60)] + [(60, None, deep[0].tolist(), flat[0].tolist(), -1)]
    df = spark.createDataFrame(rows, "id long, a array<array<double>>, b array<array<float>>, c array<double>, label int").repartition(3)
    det = MultiMahalanobis(layers=["a", "b", "c"], alpha=[1.0, 0.5, 2.0])
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("maps", "maps")
    det.fit_features(df)
    assert len(jobs.getJobIdsForGroup("maps")) <= 6  # two aggregates, adaptive stages included
    spark.sparkContext.setJobGroup("", "")
    want = np.zeros(60)
    for x, alpha in ((maps.mean(2), 1.0), (deep.astype(np.float32).astype(float).mean(2), 0.5), (flat, 2.0)):
        plain = Mahalanobis().fit_features(rows_of(spark, x, y).where("features IS NOT NULL"))
        want += alpha * np.array([s.score for s in plain.predict_features(rows_of(spark, x, y)).orderBy("id").collect()][:60])
    assert scores(det.predict_features(df)) == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError):
        det.fit_features(df.where("label = 7"))
    for cls in (Mahalanobis, RMD):  # one layer of maps, as its channel means
        one = cls(features="a", eps=0.1).fit_features(df)
        flat = cls(eps=0.1).fit_features(rows_of(spark, maps.mean(2), y).where("features IS NOT NULL"))
        plain = scores(flat.predict_features(rows_of(spark, maps.mean(2), y)))
        assert scores(one.predict_features(df)) == pytest.approx(plain, rel=1e-9)
    tanh = Mahalanobis(features="a", head=H.Head([H.Tanh()])).fit_features(df)
    flat = Mahalanobis().fit_features(rows_of(spark, np.tanh(maps.mean(2)), y).where("features IS NOT NULL"))
    assert scores(tanh.predict_features(df)) == pytest.approx(scores(flat.predict_features(rows_of(spark, np.tanh(maps.mean(2)), y))), rel=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "l1"])
@pytest.mark.parametrize("large", [False, True])
def test_nearest_rows_in_many_dimensions(spark, monkeypatch, metric, large):
    """Exact for every metric, in one bank and in cells; half of the bank are copies of one row."""
    from plumbline.operators import classwise

    monkeypatch.setattr(classwise, "BANK_NUMBERS", 10 if large else 10**9)
    monkeypatch.setattr(classwise, "BLOCK", 40)
    r = np.random.default_rng(6)
    x = r.normal(size=(240, 24)) @ np.diag(0.7 ** np.arange(24)) @ np.linalg.qr(r.normal(size=(24, 24)))[0] + 3
    x[120:200] = x[0]
    y = np.r_[np.zeros(200, int), np.full(40, -1)]
    df = rows_of(spark, x, y).repartition(5)
    got = scores(KNN(metric=metric).fit_features(df).predict_features(df))
    bank = x[:200]
    if metric == "cosine":
        u = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        want = (1 - u(x) @ u(bank).T).min(1)
    else:
        want = np.linalg.norm(x[:, None] - bank, ord=1 if metric == "l1" else 2, axis=2).min(1)
    assert got == pytest.approx(want, rel=1e-7, abs=1e-7)
    with pytest.raises(ValueError):
        KNN(metric="hamming")


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "l1"])
def test_most_coordinates_are_ruled_out(metric):
    """64 dimensions whose variances fall off, as those of trained features do: a part of the coordinates of all pairs is compared.

    Isotropic rows, the worst case, cost little more than all pairs.
    """
    from plumbline.operators.classwise import Searcher

    r = np.random.default_rng(9)
    falling = r.normal(size=(3000, 64)) * 0.9 ** np.arange(64)
    turn = np.eye(64) if metric == "l1" else np.linalg.qr(r.normal(size=(64, 64)))[0]
    for z, most in ((falling @ turn + 1, 0.45), (r.normal(size=(3000, 64)), 1.2)):
        bank, asked = z[:2500], z[2500:]
        unit = Searcher(np.zeros(64), np.eye(64), metric).unit(bank)
        s = Searcher.about(unit.mean(0), np.cov(unit.T), metric)
        found = s.result(s.nearest(s.turned(asked), s.turned(bank)))
        a, b = s.unit(asked), unit
        if metric == "l1":
            want = np.array([np.abs(b - x).sum(1).min() for x in a])
        else:
            d2 = np.array([((b - x) ** 2).sum(1).min() for x in a])
            want = d2 / 2 if metric == "cosine" else np.sqrt(d2)
        assert found == pytest.approx(want, rel=1e-9)
        assert s.work < most * len(asked) * len(bank) * 64, s.work / (len(asked) * len(bank) * 64)
