"""Detectors fitted on means and covariances: Mahalanobis, its relative and multi-layer forms, and ViM.

Fits are two passes of distributed sums (means, then scatter about them); what reaches the driver is C x D and D x D
numbers. Predictions are matrix products on Arrow batches against those matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType

from ..functions import heads as H
from ..functions import vectors as V
from .base import Detector, RequiresFittingException
from .moments import class_means, layered_moments, scatter, stacked, vector_mean

RIDGE = 1e-6


def _rowwise(score, *matrices):
    """A pandas UDF from ``score(features matrix, *matrices) -> vector``; null features give a null score."""

    @pandas_udf("double")
    def scored(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        ok = vectors.notna().to_numpy()
        if ok.any():
            out[ok] = score(_matrix(vectors[ok]), *matrices)
        return pd.Series(out).where(pd.Series(ok), None)

    return scored


def _matrix(rows: pd.Series) -> np.ndarray:
    """Vectors as a matrix; of feature maps (channels of positions) each channel's mean."""
    first = rows.iloc[0]
    if not (len(first) and isinstance(first[0], np.ndarray)):
        return stacked(rows)
    even = lambda row: np.concatenate(row).reshape(len(row), -1).mean(axis=1, dtype=np.float64)
    return np.stack([even(row) if len({len(c) for c in row}) == 1 else np.array([c.mean(dtype=np.float64) for c in row]) for row in rows])


def _channel_means():
    """:func:`_matrix` as a column function: functions on its result can follow in Python, as they can't on an expression with lambdas."""

    @pandas_udf("array<double>")
    def means(maps: pd.Series) -> pd.Series:
        out, at = np.full(len(maps), None, object), np.flatnonzero(maps.notna().to_numpy())
        for k, row in zip(at, _matrix(maps.iloc[at]) if len(at) else ()):
            out[k] = row
        return pd.Series(out)

    return means


def _is_map(df: DataFrame, features: str) -> bool:
    kind = df.schema[features].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)


def nearest_mahalanobis(z: np.ndarray, means: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Smallest squared Mahalanobis distance to a mean: one product for the rows, one for each mean."""
    best = np.full(len(z), np.inf)
    for m in means:
        d = z - m
        best = np.minimum(best, np.einsum("ij,ij->i", d @ precision, d))
    return best


def gaussian_fit(df: DataFrame, features: str, label: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(classes, means, inverse of the pooled covariance plus a small ridge) of known rows."""
    stats = class_means(df, features, label)
    if not stats:
        raise ValueError("no rows with known labels")
    classes = sorted(stats)
    about = {k: stats[k][1] for k in classes}
    n, s = scatter(df, features, {"pooled": about}, label)["pooled"]
    return classes, np.stack([about[k] for k in classes]), np.linalg.inv(s / (n - 1) + RIDGE * np.eye(len(s)))


class Mahalanobis(Detector):
    """Half the squared distance to the nearest class mean under the pooled covariance.

    ``eps`` above 0 first moves the features one signed step along the gradient of that distance. With a ``head`` the feature
    column holds inputs: their embeddings, the head's outputs, are what is fitted and scored, and the step is on the inputs,
    along the gradient that goes back through the layers. Of feature maps (arrays of channels of positions) each channel's mean
    counts, and the step is on these means.
    """

    needs_fit = True

    def __init__(self, model=None, *, eps: float = 0.0, norm_std=None, head: H.Head | None = None, **columns) -> None:
        super().__init__(model, **columns)
        self.eps, self.norm_std, self.head = eps, norm_std, head or H.Head([])

    def _embedded(self, df: DataFrame) -> DataFrame:
        d = self._known(df)
        if _is_map(d, self.features):
            d = d.withColumn(self.features, _channel_means()(self.features))
        return d.withColumn(self.features, H.batched("array<double>", self.head.forward)(V.doubles(self.features))) if self.head.layers else d

    def fit_features(self, df: DataFrame) -> Mahalanobis:
        self.classes, self.means, self.precision = gaussian_fit(self._embedded(df), self.features, self.label)
        self.fitted = True
        return self

    @property
    def n_classes(self) -> int:
        self._check_fitted()
        return len(self.means)

    def score_column(self) -> Column:
        return self._scored(V.doubles(self.features))

    def predict_features(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return df.withColumn(self.score, self._scored(F.col(self.features) if _is_map(df, self.features) else V.doubles(self.features)))

    def _scored(self, features: Column) -> Column:
        eps, std, head = self.eps, self.norm_std, self.head

        def outwards(e, means, precision):
            d = np.stack([np.einsum("ij,ij->i", (e - m) @ precision, e - m) for m in means], axis=1)
            return (e - means[d.argmin(1)]) @ precision

        def score(z, means, precision):
            if eps > 0:
                z = H.stepped(z, head.gradient(z, lambda e: outwards(e, means, precision)), eps, std)
            return nearest_mahalanobis(head.forward(z), means, precision) / 2

        return _rowwise(score, self.means, self.precision)(features)


class RMD(Mahalanobis):
    """Relative Mahalanobis: nearest class distance minus the distance to the background.

    The background matrix is the scatter about the global mean, not divided by the number of rows, as published.
    """

    def fit_features(self, df: DataFrame) -> RMD:
        d = self._embedded(df)
        stats = class_means(d, self.features, self.label)
        if not stats:
            raise ValueError("no rows with known labels")
        self.classes = sorted(stats)
        about = {k: stats[k][1] for k in self.classes}
        rows = sum(stats[k][0] for k in self.classes)
        self.background_mean = sum(stats[k][1] * stats[k][0] for k in self.classes) / rows
        sums = scatter(d, self.features, {"pooled": about, "background": self.background_mean}, self.label)
        ridge = RIDGE * np.eye(len(self.background_mean))
        self.means = np.stack([about[k] for k in self.classes])
        self.precision = np.linalg.inv(sums["pooled"][1] / (rows - 1) + ridge)
        self.background_precision = np.linalg.inv(sums["background"][1] + ridge)
        self.fitted = True
        return self

    def _scored(self, features: Column) -> Column:
        head = self.head

        def score(z, means, precision, m0, p0):
            z = head.forward(z)
            d = z - m0
            return nearest_mahalanobis(z, means, precision) - np.einsum("ij,ij->i", d @ p0, d)

        return _rowwise(score, self.means, self.precision, self.background_mean, self.background_precision)(features)


class MultiMahalanobis(Detector):
    """One Gaussian detector a layer; the score is the weighted sum of the layers' Mahalanobis scores.

    ``layers`` names the feature columns, one a layer: vectors, or feature maps (arrays of channels of positions), of which each
    channel's mean counts. All layers are fitted in the same two passes. A row with a null layer has a null score.
    """

    needs_fit = True

    def __init__(self, model=None, *, layers: Sequence[str], alpha: Sequence[float] | None = None, **columns) -> None:
        super().__init__(model, **columns)
        self.layers = list(layers)
        self.alpha = [1.0] * len(self.layers) if alpha is None else [float(a) for a in alpha]
        if len(self.alpha) != len(self.layers):
            raise ValueError("alpha needs one weight a layer")

    def fit_features(self, df: DataFrame) -> MultiMahalanobis:
        d = self._known(df)
        self.fits = [(classes, means, np.linalg.inv(s / (n - 1) + RIDGE * np.eye(len(s)))) for classes, means, n, s in layered_moments(d, self.layers, self.label)]
        self.fitted = True
        return self

    @property
    def n_classes(self) -> int:
        self._check_fitted()
        return len(self.fits[0][0])

    def layer_scores(self) -> list[Column]:
        score = lambda z, m, p: nearest_mahalanobis(z, m, p) / 2
        return [_rowwise(score, m, p)(F.col(layer)) for layer, (_, m, p) in zip(self.layers, self.fits)]

    def score_column(self) -> Column:
        total = F.lit(0.0)
        for a, s in zip(self.alpha, self.layer_scores()):
            total = total + F.lit(a) * s
        return total


class ViM(Detector):
    """Virtual logit: the norm of the residual outside of the principal subspace, scaled, against the energy.

    ``weights`` (C x D) and ``bias`` are the linear head's. The origin is ``-pinv(W) b``; the residual space is spanned by
    the eigenvectors after the ``d`` largest; fewer features than ``d`` halve it.
    """

    needs_fit = True

    def __init__(self, model=None, *, d: int, weights, bias, **columns) -> None:
        super().__init__(model, **columns)
        self.d, self.weights, self.bias = d, np.asarray(weights, np.float64), np.asarray(bias, np.float64)
        self.origin = -np.linalg.pinv(self.weights) @ self.bias

    def fit_features(self, df: DataFrame) -> ViM:
        d = self._known(df)
        if len(self.origin) < self.d:
            self.d = len(self.origin) // 2
        got = scatter(d, self.features, {"about": self.origin})
        if not got:
            raise ValueError("no rows with known labels")
        n, s = got["about"]
        values, basis = np.linalg.eigh(s / n)
        self.residual = basis[:, np.argsort(-values, kind="stable")[self.d :]]
        norm = _rowwise(lambda z, u, r: np.linalg.norm((z - u) @ r, axis=1), self.origin, self.residual)
        top = _rowwise(lambda z, w, b: (z @ w.T + b).max(1), self.weights, self.bias)
        z = V.doubles(self.features)
        row = d.agg(F.avg(top(z)).alias("top"), F.avg(norm(z)).alias("norm")).first()
        self.alpha, self.fitted = row.top / row.norm, True
        return self

    def score_column(self) -> Column:
        alpha = self.alpha

        def score(z, w, b, u, r):
            logits = np.clip(z @ w.T + b, -100, 100)
            m = logits.max(1)
            energy = m + np.log(np.exp(logits - m[:, None]).sum(1))
            return alpha * np.linalg.norm((z - u) @ r, axis=1) - energy

        return _rowwise(score, self.weights, self.bias, self.origin, self.residual)(V.doubles(self.features))


__all__ = ["MultiMahalanobis", "Mahalanobis", "RMD", "RequiresFittingException", "ViM", "gaussian_fit", "nearest_mahalanobis", "vector_mean"]
