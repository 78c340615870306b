"""Detectors, metrics, losses, centres, splits, sources and streams against numpy and on edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels, scores, vectors
from plumbline.operators import centers, classwise, detectors, gaussian, losses, metrics, splits
from plumbline.operators.base import ModelNotSetException, RequiresFittingException
from plumbline.sources import augment, files, text
from plumbline.streaming import streams

RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three Gaussian classes in five dimensions, and outliers (-1) far from them."""
    c = RNG.normal(0, 5, (3, 5))
    x = np.concatenate([c[i % 3] + RNG.normal(size=(1, 5)) for i in range(120)] + [RNG.normal(0, 12, (30, 5))])
    y = [i % 3 for i in range(120)] + [-1] * 30
    rows = [(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label int").repartition(5).cache()
    return df, x, np.array(y)


def column(df, name="score"):
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


def head(x, y):
    w = np.stack([x[y == k].mean(0) for k in range(3)])
    return w, -(w * w).sum(1) / 2


def auroc(s, y):
    out, inn = s[y < 0], s[y >= 0]
    return ((out[:, None] > inn).sum() + 0.5 * (out[:, None] == inn).sum()) / (len(out) * len(inn))


def test_errors(spark, blobs):
    df, *_ = blobs
    with pytest.raises(ModelNotSetException):
        detectors.MaxSoftmax().predict(df)
    for det in (gaussian.Mahalanobis(), classwise.KNN(), classwise.OpenMax(), classwise.KLMatching()):
        with pytest.raises(RequiresFittingException):
            det.predict_features(df)
    with pytest.raises(ValueError):
        gaussian.Mahalanobis().fit_features(df.where("label < 0"))
    with pytest.raises(ValueError):
        losses.reduced(F.lit(1), "median")


def test_gaussian_detectors(blobs):
    df, x, y = blobs
    known, k = x[y >= 0], y[y >= 0]
    mu = np.stack([known[k == i].mean(0) for i in range(3)])
    d = known - mu[k]
    p = np.linalg.inv(d.T @ d / (len(known) - 1) + 1e-6 * np.eye(5))
    d2 = np.stack([np.einsum("ij,jk,ik->i", x - m, p, x - m) for m in mu], 1).min(1)
    got = column(gaussian.Mahalanobis().fit_features(df).predict_features(df))
    assert np.allclose(got, d2 / 2) and auroc(got, y) > 0.95
    b = known - known.mean(0)
    p0 = np.linalg.inv(b.T @ b + 1e-6 * np.eye(5))
    x0 = x - known.mean(0)
    assert np.allclose(column(gaussian.RMD().fit_features(df).predict_features(df)), d2 - np.einsum("ij,jk,ik->i", x0, p0, x0))
    multi = gaussian.MultiMahalanobis(layers=["features", "other"], alpha=[1, 2]).fit_features(df.withColumn("other", F.col("features")))
    assert np.allclose(column(multi.predict_features(df.withColumn("other", F.col("features")))), 1.5 * d2)
    w, bias = head(x, y)
    vim = gaussian.ViM(d=2, weights=w, bias=bias).fit_features(df)
    u = -np.linalg.pinv(w) @ bias
    e, v = np.linalg.eigh((known - u).T @ (known - u) / len(known))
    r = v[:, np.argsort(-e)[2:]]
    alpha = (known @ w.T + bias).max(1).mean() / np.linalg.norm((known - u) @ r, axis=1).mean()
    z = np.clip(x @ w.T + bias, -100, 100)
    want = alpha * np.linalg.norm((x - u) @ r, axis=1) - (z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)))
    assert np.allclose(column(vim.predict_features(df)), want)


def test_neighbours_small_and_blocked(blobs, monkeypatch):
    df, x, y = blobs
    want = np.sqrt(((x[:, None] - x[y >= 0][None]) ** 2).sum(2)).min(1)
    assert np.allclose(column(classwise.KNN().fit_features(df).predict_features(df)), want)
    monkeypatch.setattr(classwise, "BANK_NUMBERS", 10)
    for block, pivots in ((4096, 256), (10, 256), (10, 3)):
        monkeypatch.setattr(classwise, "BLOCK", block)
        monkeypatch.setattr(classwise, "PIVOTS", pivots)
        got = classwise.KNN().fit_features(df).predict_features(df.withColumn("asker", F.lit("x")).withColumn("d", F.lit("y")).withColumn("cell", F.lit("z")))
        assert np.allclose(column(got), want) and got.columns == [*df.columns, "asker", "d", "cell", "score"]


def test_scores_do_not_depend_on_partitions(blobs):
    df, x, y = blobs
    w, b = head(x, y)
    d = df.withColumn("logits", vectors.linear("features", w, b))
    det = classwise.OpenMax(tailsize=10).fit_features(d)
    one, many = (column(det.predict_features(d.repartition(n))) for n in (1, 9))
    assert np.allclose(one, many) and ((one >= 0) & (one <= 1)).all()
    mcd = detectors.MCD(weights=w, bias=b, samples=4)
    assert np.array_equal(column(mcd.predict_features(df.repartition(2))), column(mcd.predict_features(df.repartition(7))))
    with pytest.raises(ValueError):
        detectors.MCD(weights=w, bias=b, mode="max")


def test_weibull_fit_recovers_parameters():
    x = RNG.weibull(3.0, 20000) * 2
    shape, scale, low = classwise.weibull_fit(x, shift=x.min())
    assert abs(shape - 3) < 0.1 and abs(scale - 2) < 0.05
    assert np.isinf(classwise.weibull_fit(np.ones(5))[0])


def test_shaping_with_ties_and_full_pruning(spark):
    df = spark.createDataFrame([(0, [3.0, 1.0, 1.0, 1.0]), (1, [0.0, 0.0, 0.0, 0.0])], "id bigint, features array<double>")
    got = df.orderBy("id").select(scores.ash_p("features", 0.5).alias("p"), scores.ash_b("features", 0.5).alias("b"), scores.ash_s("features", 0.5).alias("s"), scores.ash_p("features", 1.0).alias("none"), scores.react("features", 2.0).alias("r")).collect()
    assert got[0].p == [3, 1, 0, 0] and got[0].b == [3, 3, 0, 0] and got[0].none == [0] * 4 and got[0].r == [2, 1, 1, 1]
    assert got[0].s == pytest.approx([3 * np.exp(1.5), np.exp(1.5), 0, 0])


def test_metrics(spark):
    perfect = spark.createDataFrame([(0.0, 1)] * 5 + [(1.0, -1)] * 5, "score double, label int")
    assert [round(v, 9) for v in metrics.ood_metrics(perfect).first()] == [1, 1, 1, 0]
    void = perfect.unionByName(spark.createDataFrame([(-1.0, 0)], "score double, label int"))
    assert [round(v, 9) for v in metrics.ood_metrics(void, void_label=0).first()] == [1, 1, 1, 0]
    with pytest.raises(Exception, match="both known and unknown"):
        metrics.ood_metrics(perfect.where("label > 0")).collect()
    assert metrics.ood_metrics(perfect.where("label > 0"), on_missing="null").first()[0] is None
    assert metrics.ood_metrics(perfect.limit(0)).count() == 0
    with pytest.raises(ValueError):
        metrics.OODMetrics().compute()
    s, y = np.round(RNG.normal(size=400), 1), np.where(RNG.random(400) < 0.3, -1, 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = metrics.ood_metrics(df).first()
    assert got["AUROC"] == pytest.approx(auroc(s, y))
    assert metrics.ood_metrics(df, ranges=1).first() == pytest.approx(got)
    flipped = metrics.ood_metrics(df.select((-F.col("score")).alias("score"), F.when(F.col("label") < 0, 1).otherwise(-1).alias("label"))).first()
    assert flipped["AUPR-OUT"] == pytest.approx(got["AUPR-IN"])
    with pytest.raises(Exception, match="fewer than"):
        metrics.calibration_error(df.withColumn("correct", F.lit(1)), "score", beta=1000).collect()


def test_temperature(spark):
    z = RNG.normal(size=(400, 4))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(RNG.choice(4, p=q)) for q in p]
    df = spark.createDataFrame([(i, [float(v) for v in 3 * r], k) for i, (r, k) in enumerate(zip(z, y))], "id bigint, logits array<double>, label int")
    t = metrics.temperature_calibration(df)
    assert 2 < t < 4.5
    assert detectors.TemperatureScaling().fit_features(df).t == pytest.approx(t, abs=1e-3)


def test_losses_on_one_sided_tables(spark, blobs):
    df, x, y = blobs
    w, b = head(x, y)
    d = df.withColumn("logits", vectors.linear("features", w, b))
    far = d.where("label < 0")
    assert far.agg(losses.reduced(losses.cross_entropy("logits", "label"))).first()[0] == 0
    assert far.agg(losses.reduced(losses.outlier_exposure("logits", "label"))).first()[0] > 0
    assert losses.ii_loss(far, "features", "label").first().loss == 0
    assert losses.confidence_loss(far.withColumn("c", F.lit(0.5)), "logits", "c", "label").first().loss == 0
    with pytest.raises(Exception, match="label too large"):
        d.select(losses.background_class("logits", "label", 2)).collect()
    margin = losses.EnergyMarginLoss(0.1, eta=1.0)
    assert margin.loss(d.where("label >= 0"), weight=0.1, bias=0.0).first().loss is None
    low, high = (losses.EnergyMarginLoss(0.1, eta=eta).loss(d, weight=-0.1, bias=0.0).first().loss for eta in (1.0, 5.0))
    assert low > high
    margin.step(d, weight=0.1, bias=0.0)
    assert margin.alarms.multiplier != 0


@pytest.mark.parametrize("multiplier, penalty, level", [(0.3, 2.0, 0.9), (0.3, 2.0, -5.0), (0.0, 1.0, 0.1)])
def test_constraint_terms_and_steps(spark, multiplier, penalty, level):
    c, g = losses.Constraint(0.4, multiplier, penalty), level - 0.4
    active = multiplier + penalty * g >= 0
    want = multiplier * g + penalty / 2 * g * g if active else -(multiplier**2) / (2 * penalty)
    assert spark.range(1).select(c.term(F.lit(level)).alias("t")).first().t == pytest.approx(want)
    c.step(level, rate=0.5, growth=3.0)
    assert c.multiplier == pytest.approx(multiplier + 0.5 * g if active else multiplier - 0.5 * multiplier / penalty)
    assert c.penalty == (penalty * 3 if g > 0 else penalty)


def test_centers_queue_and_virtual_outliers(spark, blobs):
    df, x, y = blobs
    run, seen = centers.RunningCenters(4, 5), np.full((4, 5), np.nan)
    for n, part in enumerate((df.where("id < 60"), df.where("id >= 60 AND label <> 1"))):
        run.update(part)
        keep = (np.arange(150) < 60) if n == 0 else ((np.arange(150) >= 60) & (y != 1))
        for k in range(3):
            rows = x[keep & (y == k)]
            if len(rows):
                seen[k] = (rows.mean(0) + np.nan_to_num(seen[k]) * n) / (n + 1)
    assert np.allclose(run.centers, seen, equal_nan=True)
    last = centers.last_rows(df, "label", "id", 4)
    assert sorted(r.id for r in last.where("label = 0").collect()) == [108, 111, 114, 117]
    v = centers.virtual_outliers(df.where("label >= 0"), sample_from=500, select=2)
    assert v.count() == 6 and sorted(v.collect()) == sorted(v.collect())
    with pytest.raises(ValueError):
        centers.virtual_outliers(df)


def test_split_and_benchmark(spark, blobs):
    df = spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("label"))
    s = splits.OpenSetSplit(df, uuc_test=4, seed=0)
    assert (len(s.kkc), len(s.uuc), len(s.kuc)) == (6, 4, 0)
    stages = {r.stage: r["count"] for r in s.rows.groupBy("stage").count().collect()}
    assert stages == {"train": 48, "val": 6, "test": 46}
    assert s.test_dataset(known=False).where("target >= 0").count() == 0
    b, *_ = blobs
    bench = splits.Benchmark(b.where("label >= 0"), {"far": b.where("label < 0")})
    got = bench.evaluate(lambda d: d.withColumn("score", vectors.norm("features"))).first()
    assert got.Dataset == "far" and 0 <= got.AUROC <= 1 and bench.test_sets(known=False)["far"].count() == 30


def test_labels(spark):
    df = spark.createDataFrame([(0,), (3,), (5,), (9,)], "label int")
    m = labels.TargetMapping([3, 5], [0])
    assert [r[0] for r in df.select(m("label")).collect()] == [-1, 0, 1, -1] and m[5] == 1
    assert labels.TargetMapping([3], [0], compat=True)[0] == 0
    with pytest.raises(Exception, match="unmapped"):
        df.select(m("label", strict=True)).collect()


def test_sources(spark, tmp_path):
    for k, name in enumerate(("Sample002", "Sample010")):
        (tmp_path / "chars" / name).mkdir(parents=True)
        (tmp_path / "chars" / name / f"{k}.png").write_bytes(b"x")
    got = files.chars74k(spark, str(tmp_path / "chars")).select("sample", "label").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (9, 1)]
    np.save(tmp_path / "fog.npy", np.arange(12).reshape(3, 4))
    np.save(tmp_path / "labels.npy", np.array([5, 6, 7]))
    rows = files.corrupted_arrays(spark, str(tmp_path), "fog").orderBy("pos").collect()
    assert [r.label for r in rows] == [5, 6, 7] and rows[1]["values"] == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        files.corrupted_arrays(spark, str(tmp_path), "rain")
    (tmp_path / "rec.bin").write_bytes(bytes(range(12)))
    assert [(r.pos, bytes(r.content)) for r in files.fixed_records(spark, str(tmp_path / "rec.bin"), 4).orderBy("pos").collect()][2] == (2, bytes([8, 9, 10, 11]))
    (tmp_path / "ng.txt").write_text("sci space the rocket is up\nnot aclass x\n")
    assert [tuple(r) for r in text.newsgroups(spark, str(tmp_path / "ng.txt")).collect()] == [("sci.space", 14, "rocket")]
    with pytest.raises(ValueError):
        text.wikitext(spark, str(tmp_path), "all")
    a, b = (files.uniform_noise(spark.newSession(), 3, 5, seed=1).repartition(n).orderBy("id").collect() for n in (1, 3))
    assert a == b and all(0 <= v <= 255 for r in a for v in r.pixels)


def test_annotations_and_mixing(spark, tmp_path):
    graph = {"images": [{"id": 1, "width": 4, "height": 3}, {"id": 2, "width": 9, "height": 9}], "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "area": 5.0, "iscrowd": 0}], "categories": [{"id": 3, "name": "cat", "supercategory": "animal"}]}
    (tmp_path / "a.json").write_text(json.dumps(graph))
    a = augment.Annotations.read(spark, str(tmp_path / "a.json"))
    assert a.annotation_ids().count() == 0 and a.annotation_ids(images=[1], area=(1, 9)).first().id == 7
    assert a.category_ids(names=["cat"]).first().id == 3 and [r.id for r in a.images_without([3]).collect()] == [2]
    assert augment.polygon_mask(np.array([[0, 0], [2, 0], [2, 2], [0, 2]]), 3, 3).sum() == 4
    df = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i / 12.0).alias("pixels"))
    bank = spark.createDataFrame([([0.5] * 12,), ([0.1 * k for k in range(12)],)], "pixels array<double>")
    out = augment.pixmix(df, bank, shape=(3, 2, 2)).orderBy("id").collect()
    assert all(0 <= v <= 1 for r in out for v in r.pixels) and len(out) == 4
    assert augment.pixmix(df.repartition(3), bank.repartition(2), shape=(3, 2, 2)).orderBy("id").collect() == out
    shifted = augment.pixmix(df, bank, shape=(3, 2, 2), mean=[0.5] * 3, std=[0.5] * 3).orderBy("id").collect()
    assert np.allclose([[v * 0.5 + 0.5 for v in r.pixels] for r in shifted], [r.pixels for r in out])


def test_streams(spark, blobs, tmp_path):
    df, x, y = blobs
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    det = gaussian.Mahalanobis().fit_features(df)
    streams.score_stream(stream, det, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert np.allclose(column(spark.read.parquet(str(tmp_path / "out"))), column(det.predict_features(df)))
    seen = []
    scored = det.predict_features(stream)
    streams.metrics_of_stream(scored, lambda m: seen.append(m.first()), str(tmp_path / "c2"), table=str(tmp_path / "t")).awaitTermination(60)
    assert seen[-1]["AUROC"] == pytest.approx(auroc(column(det.predict_features(df)), y))
    streams.running_center_stream(stream, str(tmp_path / "centers"), str(tmp_path / "c3")).awaitTermination(60)
    assert streams.centers_of(spark, str(tmp_path / "centers")).count() == 3


def test_mixing_formulas_and_augmentations():
    p, q = RNG.random((3, 4, 5)), RNG.random((3, 4, 5))
    for s, t in ((0.8, 0.1), (1.3, -0.4)):
        assert np.allclose(augment.additive(p, q, s, t), (s * (2 * p - 1) + t * (2 * q - 1) + 1) / 2)
        assert np.allclose(augment.multiplicative(p, q, s, t), (2 * p) ** s * (2 * q) ** t / 2)
    pairs = [augment.coefficients(np.random.default_rng(k), 3.0) for k in range(300)]
    assert {(s >= 1) for s, _ in pairs} == {True, False} and all((0 <= t <= 1 and s <= 1) or (-1 <= t <= 0 and 1 <= s <= 2) for s, t in pairs)
    x = np.arange(48).reshape(3, 4, 4) / 255
    assert np.allclose(augment.augmented(x, "posterise", 3) * 255, np.arange(48).reshape(3, 4, 4) // 32 * 32)
    assert np.allclose(augment.augmented(x, "solarise", 3).ravel()[:5] * 255, [0, 1, 2, 252, 251])
    assert np.allclose(augment.augmented(x, "stretch", 3)[0].ravel()[[0, -1]], [0, 1])
    assert np.allclose(augment.augmented(x, "turn", 0), x) and np.allclose(augment.turned(np.arange(9).reshape(1, 3, 3), 90)[0], np.rot90(np.arange(9).reshape(3, 3)))
    even = augment.augmented(np.repeat(np.arange(100), 30).reshape(1, 50, 60) / 255, "equalise", 3) * 255
    assert even.max() > 240 and np.all(np.diff(np.unique(even)) > 0)
    with pytest.raises(ValueError):
        augment.augmented(x, "blur", 3)


def test_pasted_objects(spark):
    df = spark.range(6).select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.array_repeat(F.lit(0.0), 192).alias("pixels"), F.array_repeat(F.lit(0), 64).alias("mask"))
    objects = spark.createDataFrame([([1.0] * 12, [1, 1, 1, 0])], "pixels array<double>, mask array<int>")
    out = augment.paste_objects(df, objects, object_size=(2, 2), probability=1.0, n=2).collect()
    for r in out:
        m, p = np.array(r.mask), np.array(r.pixels).reshape(3, 64)
        assert 0 < (m == -1).sum() < 64 and (p[:, m == -1] == 1).all() and (p[:, m == 0] == 0).all()
    with pytest.raises(ValueError):
        augment._bank(spark.range(1).select(F.array_repeat(F.lit(0), augment.BANK_NUMBERS + 1).alias("pixels")), "pixels")


def test_calibration_and_accuracy_curves_match_numpy(spark):
    c = np.round(RNG.random(1000), 2)
    c[:400] = 1.0  # one value that very many rows have
    ok = (RNG.random(1000) < c).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(c, ok)], "confidence double, correct int").repartition(7)
    order = np.lexsort((ok, c))
    n, beta = 1000, 50
    gaps = [abs(c[order[k : k + beta]].mean() - ok[order[k : k + beta]].mean()) for k in range(0, (n // beta - 1) * beta, beta)]
    want = {"1": sum(gaps) * beta / n, "2": np.sqrt(sum(g * g for g in gaps) * beta / n), "infty": max(gaps)}
    for p, w in want.items():
        assert metrics.calibration_error(df, p=p, beta=beta).first()[0] == pytest.approx(w)
    down = ok[np.lexsort((ok, -c))]
    assert metrics.aurra(df).first()[0] == pytest.approx((np.cumsum(down) / np.arange(1, n + 1)).mean(), rel=1e-9)
    linear = spark.range(1000).select((F.col("id") / 999).alias("confidence"), (F.col("id") < 500).cast("int").alias("correct"))
    assert metrics.calibration_error(linear).first()[0] > 0.3


def test_metrics_by_group_and_image(spark):
    px = spark.range(2048).select((F.col("id") % 2).alias("image_id"), F.when(F.floor(F.col("id") / 2) % 32 == 1, 1.0).otherwise(0.0).alias("score"))
    px = px.withColumn("label", F.when(F.col("score") > 0, -1).otherwise(0))
    assert [round(v, 9) for v in metrics.segmentation_metrics(px).first()] == [1, 1, 1, 0]
    s, y, g = RNG.normal(size=600), np.where(RNG.random(600) < 0.4, -1, 1), RNG.integers(0, 3, 600)
    df = spark.createDataFrame([(float(a), int(b), int(k)) for a, b, k in zip(s, y, g)], "score double, label int, part int")
    for r in metrics.ood_metrics(df, by=["part"]).collect():
        assert r.AUROC == pytest.approx(auroc(s[g == r.part], y[g == r.part]))


def test_counted_parameters_raise_beyond_their_bound(spark, blobs, monkeypatch):
    df, x, y = blobs
    w, b = head(x, y)
    from plumbline.operators import base

    assert base.known_classes(df.where("label >= 0"), "label") and pytest.raises(ValueError, base.known_classes, df, "label", 2)
    monkeypatch.setattr(classwise, "parameter_rows", lambda t: base.parameter_rows(t, 5))
    with pytest.raises(ValueError, match="parameters"):
        classwise.OpenMax(tailsize=10).fit_features(df.withColumn("logits", vectors.linear("features", w, b)))
    with pytest.raises(ValueError, match="correctly"):
        classwise.SHE(weights=-w, bias=b).fit_features(df)


def test_wide_heads_and_odin_with_a_gradient(spark, blobs, monkeypatch):
    df, x, y = blobs
    w, b = head(x, y)
    plain = np.array(column(df.withColumn("l", vectors.linear("features", w, b)), "l").tolist())
    closed = column(detectors.ODIN(weights=w, bias=b, eps=0.1).predict_features(df))
    monkeypatch.setattr(vectors, "MAX_LITERALS", 3)
    assert np.allclose(np.array(column(df.withColumn("l", vectors.linear("features", w, b)), "l").tolist()), plain) and np.allclose(plain, x @ w.T + b)

    def gradient(d):  # of the loss of the predicted class: minus its weights
        return d.withColumn("gradient", F.transform(F.element_at(vectors.literal(w), vectors.argmax(vectors.linear("features", w, b)) + 1), lambda v: -v))

    model = lambda d: d.withColumn("logits", vectors.linear("features", w, b))
    assert np.allclose(column(detectors.ODIN(model, gradient=gradient, eps=0.1).predict(df)), closed)
    scaled = column(detectors.ODIN(model, gradient=gradient, eps=0.1, norm_std=[2.0] * 5).predict(df))
    assert np.allclose(scaled, column(detectors.ODIN(model, gradient=gradient, eps=0.05).predict(df)))


def test_dense_labels_in_ranges(spark, monkeypatch):
    values = [f"k{i:03d}" for i in RNG.permutation(200)] + [None, "k001"]
    df = spark.createDataFrame([(v, "mine") for v in values], "name string, value string")
    want = {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    for sampled in (4096, 100):
        monkeypatch.setattr(labels, "SAMPLED", sampled)
        got = labels.dense_labels(df, "name").collect()
        assert len(got) == 202 and all(r.label == want.get(r.name) and r.value == "mine" for r in got)


def test_queue_keeps_columns_of_any_name(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("key"), F.lit("a").alias("_salt"), F.lit("b").alias("_rank"), F.lit("c").alias("row"))
    got = centers.last_rows(df, "key", "id", 2).collect()
    assert sorted(r.id for r in got) == [94, 95, 96, 97, 98, 99] and {(r._salt, r._rank, r.row) for r in got} == {("a", "b", "c")}


def touch(path, content=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_outlier_folders_and_variants(spark, tmp_path):
    for name in ("a/1.jpg", "a/2.png", "b/c/3.JPEG", "b/.hidden.jpg", "fog/n01/4.JPEG", "digital/n01/5.JPEG"):
        touch(tmp_path / "t" / name)
    root = str(tmp_path / "t")
    names = lambda d: sorted(r.path.rsplit("/", 1)[1] for r in d.select("path").collect())
    assert names(files.outlier_folder(spark, "Textures", root)) == ["1.jpg"] and names(files.outlier_folder(spark, "FoolingImages", root)) == ["2.png"]
    assert names(files.imagenet_variant(spark, root)) == ["1.jpg", "3.JPEG", "4.JPEG", "5.JPEG"]
    assert names(files.imagenet_c(spark, root, "digital")) == ["5.JPEG"] and pytest.raises(ValueError, files.imagenet_c, spark, root, "fog")
    for name in ("train/n02/images/x.JPEG", "train/n01/images/y.JPEG", "val/images/v.JPEG", "test/images/t.JPEG"):
        touch(tmp_path / "tiny" / name)
    (tmp_path / "tiny/val/val_annotations.txt").write_text("v.JPEG\tn07\t0\t0\n")
    tiny = str(tmp_path / "tiny")
    assert sorted((r.class_name, r.label) for r in files.tiny_imagenet(spark, tiny).collect()) == [("n01", 0), ("n02", 1)]
    assert [r.class_name for r in files.tiny_imagenet(spark, tiny, "val").collect()] == ["n07"] and files.tiny_imagenet(spark, tiny, "test").first().label == -1
    (tmp_path / "list.json").write_text('["some/1.jpg", "none.jpg"]')
    assert names(files.open_images_o(spark, root, str(tmp_path / "list.json"))) == ["1.jpg"]
    touch(tmp_path / "fsdd/7_jackson_3.wav")
    r = files.spoken_digits(spark, str(tmp_path / "fsdd")).first()
    assert (r.label, r.speaker, r.about.gender) == (7, "jackson", "male")


def test_images_and_masks_are_paired(spark, tmp_path):
    touch(tmp_path / "fs/0000_city_01_02_rgb.npz", b"o")
    touch(tmp_path / "fs/0000_city_01_02_labels.png", b"v")
    touch(tmp_path / "cs/city/city_01_02_leftImg8bit.png", b"r")
    r = files.fishyscapes(spark, str(tmp_path / "fs"), str(tmp_path / "cs")).first()
    assert (bytes(r.content), bytes(r.mask), bytes(r.original)) == (b"o", b"v", b"r")
    touch(tmp_path / "lf/0000_04_Street_01_02_labels.png", b"m")
    touch(tmp_path / "lo/test/04_Street/04_Street_01_02_leftImg8bit.png", b"i")
    r = files.lost_and_found(spark, str(tmp_path / "lf"), str(tmp_path / "lo")).first()
    assert (bytes(r.content), bytes(r.mask)) == (b"i", b"m")
    for part, v in (("images", b"i"), ("annotations", b"a")):
        touch(tmp_path / f"my images/sh/train/{part}/training/t1/1.png", v)
    r = files.street_hazards(spark, str(tmp_path / "my images/sh"), "train").first()
    assert (bytes(r.content), bytes(r.mask)) == (b"i", b"a") and pytest.raises(ValueError, files.street_hazards, spark, "x", "all")
    for name, v in (("pill/test/good/000.png", b"g"), ("pill/test/crack/000.png", b"c"), ("pill/ground_truth/crack/000_mask.png", b"m"), ("tile/train/good/000.png", b"t")):
        touch(tmp_path / "ad" / name, v)
    got = files.inspection(spark, str(tmp_path / "ad"), "test").collect()
    assert sorted((r.defect, bytes(r.content), r.mask and bytes(r.mask)) for r in got) == [("crack", b"c", b"m"), ("good", b"g", None)]
    assert files.inspection(spark, str(tmp_path / "ad"), "train", "tile").count() == 1 and files.inspection(spark, str(tmp_path / "ad"), "train", "pill").count() == 0
    (tmp_path / "sum").mkdir()
    np.savez(tmp_path / "sum/x-test.npz", np.zeros((2, 4)))
    np.savez(tmp_path / "sum/y-test.npz", np.array([[5, 5, 5, 5], [1, 2, 3, 4]]))
    np.savez(tmp_path / "sum/b-test.npz", np.tile(np.array([0, 10, 2, 20]), (2, 4, 1)))
    got = files.summed_digits(spark, str(tmp_path / "sum"), "test").orderBy("pos").collect()
    assert [r.target.anomaly for r in got] == [0, -1] and got[0].target.boxes[0] == [0, 2, 10, 20] and got[0].target.area == [180] * 4


def test_named_benchmarks(spark, tmp_path):
    from plumbline.operators import benchmarks

    record = lambda label, fill, labels=1: bytes([9] * (labels - 1) + [label]) + bytes([fill]) * 3072
    touch(tmp_path / "cifar-10-batches-bin/data_batch_1.bin", record(3, 10) * 4)
    touch(tmp_path / "cifar-10-batches-bin/test_batch.bin", record(3, 10) + record(4, 12))
    touch(tmp_path / "cifar-100-binary/test.bin", record(80, 200, 2) * 3)
    touch(tmp_path / "MNIST/raw/t10k-images-idx3-ubyte", bytes(16) + bytes([50]) * 784 * 2)
    touch(tmp_path / "MNIST/raw/t10k-labels-idx1-ubyte", bytes(8) + bytes([7, 1]))
    touch(tmp_path / "dtd/images/dots/1.jpg", bytes([99]) * 5)
    assert sorted(r.label for r in files.idx_images(spark, str(tmp_path / "MNIST/raw"), False).collect()) == [1, 7]

    def transform(d):  # the first byte stands for what a decoder and a model would find
        return d.select("label", F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("double").alias("score"))

    b = benchmarks.named_benchmark(spark, "CIFAR10_OpenOOD", str(tmp_path), transform, outliers=("CIFAR100", "MNIST", "Textures"))
    got = {r.Dataset: r.AUROC for r in b.evaluate(lambda d: d).collect()}
    assert got == {"CIFAR100": 1.0, "MNIST": 1.0, "Textures": 1.0} and b.train_set().count() == 4
    assert {r.label for r in b.test_sets()["CIFAR100"].collect()} == {3, 4, -1}
    with pytest.raises(ValueError):
        benchmarks.named_benchmark(spark, "CIFAR10_ODIN", str(tmp_path), transform, outliers=("MNIST",))
    assert set(benchmarks.OUTLIERS) == {k for _, _, names in benchmarks.BENCHMARKS.values() for k in names}
    assert benchmarks.OUTLIERS["UniformNoise"](spark, "").select(F.size("content")).first()[0] == 3072


def test_extracted_features(spark):
    from plumbline.operators.base import extracted_features

    df = spark.createDataFrame([(0, [[1.0, 3.0], [5.0, 7.0]]), (-1, [[0.0, 0.0], [0.0, 0.0]])], "label int, features array<array<double>>")
    assert [r.embedding for r in extracted_features(df, lambda d: d).collect()] == [[1, 3, 5, 7]]
    assert [r.embedding for r in extracted_features(df, lambda d: d, average=True).collect()] == [[2, 6]]
    assert vectors.normalisation_of("cifar10")[1] == [63 / 255, 62.1 / 255, 66.7 / 255] and pytest.raises(ValueError, vectors.normalisation_of, "x")


def test_last_n_stream_and_counts_over_batches(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("key"), (F.col("id") * 1.0).alias("value"), (F.col("id") % 4).cast("double").alias("score"), F.when(F.col("id") % 4 == 3, -1).otherwise(0).alias("label"))
    for k in range(4):
        df.where(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    streams.metrics_of_stream(stream, lambda m: seen.append(m.first()), str(tmp_path / "c"), table=str(tmp_path / "t")).awaitTermination(120)
    assert len(seen) == 4 and seen[-1]["AUROC"] == 1 and seen[0]["AUROC"] is None
    assert len(list((tmp_path / "t").glob("v*"))) <= 2
    queue = streams.last_n_stream(stream, "key", "id", "value", 3)
    q = queue.writeStream.format("memory").queryName("queues").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("queues").collect():
        last[r.key] = max(last.get(r.key, []), r.sequence)
    assert last == {"0": [34, 36, 38], "1": [35, 37, 39]}


def test_noise_does_not_depend_on_partitions(spark):
    a = files.gaussian_noise(spark, 50, 200)
    mean, deviation = a.select(F.explode("pixels").alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert 110 < mean < 145 and 70 < deviation < 110
    u = files.uniform_noise(spark, 50, 200).select(F.explode("pixels").alias("v")).agg(F.avg("v").alias("m"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert 120 < u.m < 135 and u.a == 0 and u.b == 254


def test_entry_without_the_corpus_operators(tmp_path):
    """The engine stands alone: with the corpus folders gone, the entry imports and has its own queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
