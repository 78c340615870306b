"""Detectors that compare a row with what was learned about its predicted class: KL matching, SHE, OpenMax, 1-NN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import heads as H
from ..functions import scores as S
from ..functions import vectors as V
from ..scratch import written
from .base import Detector, known_classes, parameter_rows
from .moments import class_means, scatter, stacked, vector_mean

#: Numbers of a bank of vectors up to which it is sent to every executor whole; larger banks are dealt to cells and blocks.
BANK_NUMBERS = 16_000_000
BLOCK, PIVOTS = 4096, 256


def _by_class(table: dict[int, np.ndarray], key: Column, missing: str) -> Column:
    """The vector of a class from a fitted table, as one constant map; classes that were not fitted raise."""
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(int(k)), V.literal(v))]
    got = F.try_element_at(F.create_map(*pairs), key.cast("int"))
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(missing), key.cast("string"))).cast("array<double>"))


def _large(table: dict[int, np.ndarray]) -> bool:
    """Whether a fitted table has more numbers than a plan should hold; then rows look it up in Arrow batches."""
    return sum(map(np.size, table.values())) > V.MAX_LITERALS


class KLMatching(Detector):
    """KL divergence of a row's class probabilities from the mean probabilities of its predicted class.

    Fits on ``logits`` by given label, predicts on probabilities (column ``probabilities``); :meth:`predict` applies the
    softmax in between. A predicted class that no fitted row had raises.
    """

    needs_fit = True

    def __init__(self, model=None, *, probabilities: str = "probabilities", **columns) -> None:
        super().__init__(model, **columns)
        self.probabilities = probabilities

    def fit_features(self, df: DataFrame) -> KLMatching:
        stats = class_means(self._known(df), V.softmax(V.doubles(self.logits)), self.label)
        if not stats:
            raise ValueError("no rows with known labels")
        self.table, self.fitted = {k: m for k, (_, m) in stats.items()}, True
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        soft = H.batched("array<double>", H.softmax) if _large(self.table) else V.softmax
        d = self._modelled(df).withColumn(self.probabilities, soft(V.doubles(self.logits)))
        return self.predict_features(d)

    __call__ = predict

    def score_column(self) -> Column:
        p, table = V.doubles(self.probabilities), self.table
        if _large(table):

            def divergence(p: np.ndarray) -> np.ndarray:
                q = H.class_rows(table, p.argmax(axis=1), "no fitted rows of class ")
                with np.errstate(divide="ignore", invalid="ignore"):
                    return np.where(p > 0, p * (np.log(p) - np.log(np.maximum(q, 1e-300))), 0.0).sum(axis=1)

            return H.batched("double", divergence)(p)
        return S.kl_divergence(p, _by_class(self.table, V.argmax(p), "no fitted rows of class "))


class SHE(Detector):
    """Minus the inner product with the stored pattern of the predicted class: the mean of its correctly classified rows."""

    needs_fit = True

    def __init__(self, model=None, *, weights, bias, **columns) -> None:
        super().__init__(model, **columns)
        self.weights, self.bias = weights, bias

    def _predicted(self) -> Column:
        return V.argmax(V.linear(V.doubles(self.features), self.weights, self.bias))

    def fit_features(self, df: DataFrame) -> SHE:
        d = self._known(df)
        right = d.where(self._predicted() == F.col(self.label))
        stats = class_means(right, self.features, self.label)
        lost = [k for k in known_classes(d, self.label) if k not in stats]
        if lost or not stats:
            raise ValueError(f"classes without a correctly classified row: {sorted(lost)}")
        self.table, self.fitted = {k: m for k, (_, m) in stats.items()}, True
        return self

    def score_column(self) -> Column:
        z, table = V.doubles(self.features), self.table
        if _large(table) or np.size(self.weights) > V.MAX_LITERALS:
            head = H.linear_head(self.weights, self.bias)
            return H.batched("double", lambda z: -(z * H.class_rows(table, head.forward(z).argmax(axis=1), "no stored pattern of class ")).sum(axis=1))(z)
        return -V.dot(z, _by_class(self.table, self._predicted(), "no stored pattern of class "))


# ---------------------------------------------------------------- OpenMax


def weibull_fit(values: np.ndarray, shift: float = 10000.0, rounds: int = 200) -> tuple[float, float, float]:
    """(shape, scale, lowest value) of a two-parameter Weibull on ``values + shift - min``, by maximum likelihood.

    Newton's method on the shape with the values' logarithms, begun at the Gumbel moments; all in double precision,
    since the shift makes the shape very large. Equal values give a shape of infinity: a step at the scale.
    """
    low = float(values.min())
    logs = np.log(values - low + shift)
    spread = logs.std()
    if spread < 1e-14:
        return np.inf, float(np.exp(logs.mean())), low
    center, y = logs.mean(), logs - logs.mean()
    c = np.pi / (np.sqrt(6) * spread)
    for _ in range(rounds):
        w = np.exp(c * (y - y.max()))
        s0, s1, s2 = w.sum(), (w * y).sum(), (w * y * y).sum()
        f = s1 / s0 - 1 / c - y.mean()
        step = f / ((s2 * s0 - s1 * s1) / s0**2 + 1 / c**2)
        new = c - step
        c = new if new > 0 else c / 2
        if abs(step) <= 1e-12 * c:
            break
    scale = np.exp(center + y.max() + np.log(np.exp(c * (y - y.max())).mean()) / c)
    return float(c), float(scale), low


def weibull_cdf(distance: np.ndarray, shape: float, scale: float, low: float, shift: float = 10000.0) -> np.ndarray:
    x = np.maximum(distance + shift - low, 1e-300)
    with np.errstate(over="ignore"):
        if np.isinf(shape):
            return (x >= scale).astype(np.float64)
        return -np.expm1(-np.exp(np.minimum(shape * (np.log(x) - np.log(scale)), 700.0)))


def with_weibull(df: DataFrame, distance: str, name: str, shape: float, scale: float, low: float, shift: float = 10000.0) -> DataFrame:
    """``df`` plus ``name``: the Weibull probability of each distance."""

    @pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(weibull_cdf(x.to_numpy(np.float64), shape, scale, low, shift))

    return df.withColumn(name, cdf(F.col(distance).cast("double")))


def distances_to(z: np.ndarray, center: np.ndarray, euclid_weight: float) -> np.ndarray:
    out = np.zeros(len(z))
    if euclid_weight:
        out += euclid_weight * np.linalg.norm(z - center, axis=1)
    if euclid_weight != 1:
        out += (1 - euclid_weight) * (1 - z @ center / np.maximum(np.linalg.norm(z, axis=1) * np.linalg.norm(center), 1e-300))
    return out


def class_tails(df: DataFrame, vector: str, label: str, centers: dict[int, np.ndarray], size: int, euclid_weight: float = 1.0) -> DataFrame:
    """(label, distance): the ``size`` largest distances of each class to its centre.

    Every task keeps its own largest first, so a class of any share of the rows reaches the window as a few rows a task.
    """

    def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            z, y = stacked(f["z"]), f["label"].to_numpy()
            for k in np.unique(y):
                d = distances_to(z[y == k], centers[int(k)], euclid_weight)
                kept[int(k)] = np.sort(np.r_[kept.get(int(k), np.zeros(0)), d])[-size:]
        for k, d in kept.items():
            yield pd.DataFrame({"label": k, "distance": d})

    partial = df.select(F.col(label).cast("int").alias("label"), V.doubles(vector).alias("z")).mapInPandas(largest, "label int, distance double")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("distance").desc()))
    return partial.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


class OpenMax(Detector):
    """Probability of the unknown class after logits are revised by Weibull models of the distances to class means.

    Distances to all of the ``alpha`` top classes count, whichever rows share a batch. Rows with null logits aren't learned from and
    have a null score.
    """

    needs_fit = True

    def __init__(self, model=None, *, tailsize: int = 25, alpha: int = 10, euclid_weight: float = 1.0, **columns) -> None:
        super().__init__(model, **columns)
        self.tailsize, self.alpha, self.euclid_weight = tailsize, alpha, euclid_weight

    def fit_features(self, df: DataFrame) -> OpenMax:
        d = self._known(df).where(F.col(self.logits).isNotNull())
        stats = class_means(d, self.logits, self.label)
        if not stats:
            raise ValueError("no rows with known labels")
        self.centers = {k: m for k, (_, m) in stats.items()}
        tails = class_tails(d, self.logits, self.label, self.centers, self.tailsize, self.euclid_weight)
        got = parameter_rows(tails)
        order = np.argsort(got["label"], kind="stable")
        kinds, at = np.unique(got["label"][order], return_index=True)
        self.weibulls = {int(k): weibull_fit(d) for k, d in zip(kinds, np.split(got["distance"][order], at[1:]))}
        self.fitted = True
        return self

    def _revised(self):
        centers, weibulls, top, weight = self.centers, self.weibulls, self.alpha, self.euclid_weight

        def revised(vectors: pd.Series) -> np.ndarray:
            x = stacked(vectors)
            alpha = min(x.shape[1], top)
            order = np.argsort(-x, axis=1, kind="stable")[:, :alpha]
            ranked = np.zeros_like(x)
            np.put_along_axis(ranked, order, ((alpha + 1) - np.arange(1, alpha + 1)) / max(alpha, 1) * np.ones((len(x), 1)), axis=1)
            w = np.ones_like(x)
            for k in range(x.shape[1]):
                if k in weibulls:
                    w[:, k] = weibull_cdf(distances_to(x, centers[k], weight), *weibulls[k])
            keep = 1 - w * ranked
            out = np.concatenate([(x * (1 - keep)).sum(1, keepdims=True), x * keep], axis=1)
            e = np.exp(out - out.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        return revised

    def _with(self, df: DataFrame, name: str, kind, pick) -> DataFrame:
        # a step of its own, so that the logits are computed below it and not inside of the function's arguments
        revised, logits = self._revised(), self.logits
        d = df.drop(name)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    made, ok = np.full(len(f), None, object), np.flatnonzero(f[logits].notna().to_numpy())
                    if len(ok):
                        for k, value in zip(ok, pick(revised(f[logits].iloc[ok]))):
                            made[k] = value
                    yield f.assign(**{name: made})

        return d.mapInPandas(work, StructType([*d.schema.fields, StructField(name, kind)]))

    def probabilities(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        """All probabilities as an array column, the unknown class first."""
        self._check_fitted()
        return self._with(df, name, ArrayType(DoubleType()), list)

    def predict_features(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return self._with(df, self.score, DoubleType(), lambda p: p[:, 0])


# ---------------------------------------------------------------- nearest neighbour

METRICS = ("euclidean", "cosine", "l1")
#: Coordinates in a row's first bound, and the share of pairs left from which on pairs are followed one by one.
PREFIX, FEW = 8, 0.05


class Searcher:
    """Exact distances to the nearest of a bank's rows, most of which are ruled out by their first coordinates.

    Vectors are moved and turned to the principal axes of the bank, which keeps their Euclidean distances and puts most of them
    into the first coordinates. (Turns don't keep L1 distances: there coordinates are put in order of their variance.) The
    distance over a prefix of the coordinates is a lower bound; rows whose bound is above the best distance so far are left
    out. Prefixes are doubled for whole blocks until few pairs are left, and these get the remaining coordinates one by one; where
    no bound helps, as in isotropic data, that ends as one product of both blocks. Cosine distances are half the squared
    Euclidean ones of unit vectors. ``work`` counts the coordinates that were compared.
    """

    def __init__(self, mean: np.ndarray, axes: np.ndarray, metric: str = "euclidean") -> None:
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.mean, self.axes, self.metric, self.work = mean, axes, metric, 0

    @classmethod
    def about(cls, mean: np.ndarray, covariance: np.ndarray, metric: str = "euclidean") -> Searcher:
        values, axes = np.linalg.eigh(covariance) if metric != "l1" else (np.diag(covariance), np.eye(len(covariance)))
        return cls(mean, axes[:, np.argsort(-values, kind="stable")], metric)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (self.unit(x) - self.mean) @ self.axes

    def unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.metric == "cosine" else x

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of turned rows, pair by pair, by direct differences."""
        self.work += a.size
        return np.abs(a - b).sum(axis=1) if self.metric == "l1" else np.linalg.norm(a - b, axis=1)

    def _all_pairs(self, z: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What some coordinates add to the bounds of all pairs: squares, or amounts for L1."""
        self.work += len(b) * z.size
        if self.metric != "l1":
            return (z * z).sum(1)[:, None] + (b * b).sum(1) - 2 * z @ b.T
        out = np.zeros((len(z), len(b)))
        for k in range(z.shape[1]):
            out += np.abs(z[:, k, None] - b[:, k])
        return out

    def nearest(self, z: np.ndarray, bank: np.ndarray, best: np.ndarray | None = None) -> np.ndarray:
        """Smallest distance (Euclidean also for cosine) of each turned row to the turned rows of ``bank``, or ``best`` if that is less."""
        best = np.full(len(z), np.inf) if best is None else best.copy()
        for lo in range(0, len(bank), BLOCK):
            for at in range(0, len(z), 512):
                best[at : at + 512] = self._block(z[at : at + 512], bank[lo : lo + BLOCK], best[at : at + 512])
        return best

    def _block(self, z: np.ndarray, b: np.ndarray, best: np.ndarray) -> np.ndarray:
        dim, done, end, bound = z.shape[1], 0, min(PREFIX, z.shape[1]), 0.0
        # what the rounding of products may take from a bound
        slack = 0.0 if self.metric == "l1" else 1e-11 * ((z * z).sum(1) + (b * b).sum(1).max(initial=0))[:, None]
        over = lambda d: (d if self.metric == "l1" else d * d)[:, None] * (1 + 1e-12) + slack
        while True:
            bound, done = bound + self._all_pairs(z[:, done:end], b[:, done:end]), end
            best = np.minimum(best, self.between(z, b[bound.argmin(axis=1)]))
            row, col = np.nonzero(bound <= over(best))
            if done == dim or len(row) <= FEW * bound.size:
                break
            end = min(dim, 2 * done)
        if done < dim:
            self.work += len(row) * (dim - done)
            d = z[row, done:] - b[col, done:]
            low = bound[row, col] + (np.abs(d) if self.metric == "l1" else d * d).sum(axis=1)
            keep = low <= over(best)[row, 0]
            row, col = row[keep], col[keep]
        for k in range(0, len(row), 1 << 16):
            r = row[k : k + (1 << 16)]
            np.minimum.at(best, r, self.between(z[r], b[col[k : k + (1 << 16)]]))
        return best

    def result(self, d: np.ndarray) -> np.ndarray:
        return d * d / 2 if self.metric == "cosine" else d


def _to_pivots(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """All Euclidean distances of rows to pivots, by direct differences, so that they are exact to rounding."""
    return np.stack([np.linalg.norm(z - p, axis=1) for p in pivots], axis=1)


def _compared(searcher: Searcher):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block, bank rows (side 0) first: holds one block of the bank, queries stream past it."""
        block, parts, bank = None, [], None
        for f in frames:
            for key, g in f.groupby(["cell", "sub"], sort=False):
                if key != block:
                    block, parts, bank = key, [], None
                mine, asked = g[g["side"] == 0], g[g["side"] == 1]
                if len(mine):
                    parts.append(stacked(mine["v"]))
                if len(asked) and parts:
                    bank = np.concatenate(parts) if bank is None else bank
                    yield pd.DataFrame({"asker": asked["asker"], "d": searcher.nearest(stacked(asked["v"]), bank, asked["d"].fillna(np.inf).to_numpy(np.float64))})

    return work


class KNN(Detector):
    """Distance to the nearest known training row, exact: ``metric`` euclidean, cosine or l1.

    Rows are turned to the bank's principal axes, where prefixes of coordinates rule out most pairs (see :class:`Searcher`). A
    bank up to BANK_NUMBERS numbers goes to every executor. A larger one is dealt to the cells of PIVOTS of its rows, and large
    cells to blocks of about BLOCK rows, copies of a row to different ones. A query is first compared with the cell of its
    nearest pivot; then with each other cell that can hold a nearer row, by the cell's radius and by the plane between both
    pivots. Rows of ``df`` must have ids of their own in ``row_id``. Null features give a null score.
    """

    needs_fit = True

    def __init__(self, model=None, *, row_id: str = "id", metric: str = "euclidean", **columns) -> None:
        super().__init__(model, **columns)
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.row_id, self.metric = row_id, metric

    def fit_features(self, df: DataFrame) -> KNN:
        raw = self._known(df).select(V.doubles(self.features).alias("v")).where("v IS NOT NULL")
        if self.metric == "cosine":
            raw = raw.select(H.batched("array<double>", lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300))("v").alias("v"))
        size = raw.agg(F.sum(F.size("v")).alias("n"), F.count("*").alias("rows")).first()
        if not size.n:
            raise ValueError("no rows with known labels")
        _, mean = vector_mean(raw, "v")
        n, products = scatter(raw, "v", {"mean": mean})["mean"]
        self.searcher = Searcher.about(mean, products / n, self.metric)
        self.bank = raw.select(self._turned()("v").alias("v"))
        self.matrix = None
        if size.n <= BANK_NUMBERS:
            self.matrix = np.stack([np.asarray(v) for v in self.bank.toArrow()["v"].to_numpy(zero_copy_only=False)])
        else:
            many = min(PIVOTS, max(1, size.rows // BLOCK))
            share = min(1.0, 64 * many / size.rows)  # a sample by hash, large enough for as many different rows
            some = self.bank.where(V.unit_hash(F.col("v"), "pivot") <= F.lit(share)).distinct().orderBy(F.xxhash64("v")).limit(many)
            chosen = some.toArrow()["v"].to_numpy(zero_copy_only=False)
            if not len(chosen):
                chosen = self.bank.limit(1).toArrow()["v"].to_numpy(zero_copy_only=False)
            self.pivots = np.stack([np.asarray(v) for v in chosen])
            cells = self.bank.select(self._cell()("v").alias("at")).select("at.*").groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect()
            self.cells = {c.cell: (c.r, -(-c.n // BLOCK)) for c in cells}
        self.fitted = True
        return self

    def _turned(self):
        return H.batched("array<double>", self.searcher.turned)

    def _cell(self):
        pivots = self.pivots

        @pandas_udf("cell int, r double")
        def cell(vectors: pd.Series) -> pd.DataFrame:
            d = _to_pivots(stacked(vectors), pivots) if len(vectors) else np.zeros((0, 1))
            k = d.argmin(1)
            return pd.DataFrame({"cell": k.astype(np.int32), "r": d[np.arange(len(d)), k]})

        return cell

    def _others(self):
        pivots, cells = self.pivots, self.cells

        @pandas_udf("array<int>")
        def others(vectors: pd.Series, cell: pd.Series, near: pd.Series) -> pd.Series:
            d = _to_pivots(stacked(vectors), pivots) if len(vectors) else np.zeros((0, len(pivots)))
            own, best = cell.to_numpy(), near.to_numpy() * (1 + 1e-9)
            home = d[np.arange(len(d)), own]
            open_ = np.zeros(d.shape, bool)
            for k, (r, _) in cells.items():
                open_[:, k] = (d[:, k] - r <= best) & ((d[:, k] - home) / 2 <= best)
            open_[np.arange(len(d)), own] = False
            return pd.Series([np.flatnonzero(x).astype(np.int32) for x in open_])

        return others

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(asker, d): the smallest distance of each query (asker, v, cell, d: the best so far) to the rows of its cells."""
        subs = F.create_map(*[F.lit(x) for k, (_, n) in sorted(self.cells.items()) for x in (int(k), int(n))])
        of = lambda c: F.try_element_at(subs, c)
        cell = F.col("at.cell")
        bank = self.bank.select("v", self._cell()("v").alias("at"))
        sub = F.pmod(F.xxhash64("v", F.spark_partition_id()), of(cell).cast("bigint")).cast("int")
        bank = bank.select(F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("asker"), "v", F.lit(None).cast("double").alias("d"), cell.alias("cell"), sub.alias("sub"))
        spread = queries.withColumn("sub", F.explode(F.sequence(F.lit(0), of(F.col("cell")) - 1)))
        both = bank.unionByName(spread.select(F.lit(1).alias("side"), "asker", "v", "d", "cell", "sub")).repartition("cell", "sub").sortWithinPartitions("cell", "sub", "side")
        return both.mapInPandas(_compared(self.searcher), "asker bigint, d double").groupBy("asker").agg(F.min("d").alias("d"))

    def predict_features(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        searcher = self.searcher
        if self.matrix is not None:
            bank = self.matrix
            return df.withColumn(self.score, H.batched("double", lambda z: searcher.result(searcher.nearest(searcher.turned(z), bank)))(V.doubles(self.features)))
        own = [c for c in df.columns if c != self.score]
        asked = df.select(F.col(f"`{self.row_id}`").cast("bigint").alias("asker"), self._turned()(V.doubles(self.features)).alias("v")).where("v IS NOT NULL")
        first = asked.withColumn("at", self._cell()("v")).select("asker", "v", F.col("at.cell").alias("cell"), F.lit(None).cast("double").alias("d"))
        near = written(first.drop("d").join(self._asked(first), "asker"), "near")
        more = near.select("asker", "v", "d", F.explode(self._others()("v", "cell", "d")).alias("cell"))
        low = near.select("asker", "d").unionByName(self._asked(more)).groupBy("asker").agg(F.min("d").alias("d"))
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
        joined = rows.join(low, F.col(f"row.`{self.row_id}`").cast("bigint") == F.col("asker"), "left")
        score = F.col("d") * F.col("d") / 2 if self.metric == "cosine" else F.col("d")
        return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in own], score.alias(self.score))
