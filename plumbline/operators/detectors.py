"""Detectors on logits and activations: every prediction is a projection, no fit needs more than aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heads as H
from ..functions import scores as S
from ..functions import vectors as V
from .base import Detector
from .metrics import cross_entropy_at
from .moments import vector_mean


class MaxSoftmax(Detector):
    """Minus the largest softmax probability at temperature ``t``."""

    def __init__(self, model=None, t: float = 1.0, **columns) -> None:
        super().__init__(model, **columns)
        self.t = t

    def score_column(self) -> Column:
        return S.max_softmax(self.logits, self.t)


class MaxLogit(Detector):
    """Minus the largest logit."""

    def score_column(self) -> Column:
        return S.max_logit(self.logits)


class EnergyBased(Detector):
    """Minus ``t`` times the log-sum-exp of the tempered logits."""

    def __init__(self, model=None, t: float = 1.0, **columns) -> None:
        super().__init__(model, **columns)
        self.t = t

    def score_column(self) -> Column:
        return S.energy(self.logits, self.t)


class WeightedEBO(Detector):
    """Energy with one non-negative weight a class."""

    def __init__(self, model=None, *, weights, **columns) -> None:
        super().__init__(model, **columns)
        self.weights = np.asarray(weights, np.float64).ravel()

    def score_column(self) -> Column:
        return S.weighted_energy(self.logits, self.weights)


class Entropy(Detector):
    """Entropy of the softmax."""

    def score_column(self) -> Column:
        return S.entropy(self.logits)


class TemperatureScaling(MaxSoftmax):
    """MaxSoftmax at the temperature that fits the known rows best.

    The loss is convex in 1/T. Each pass evaluates a grid of temperatures in one aggregate and keeps the cells around
    the best, so the number of passes is fixed by the tolerance and not by an optimiser's path.
    """

    needs_fit = True

    def __init__(self, model=None, *, lower: float = 0.01, upper: float = 100.0, tolerance: float = 1e-5, **columns) -> None:
        super().__init__(model, 1.0, **columns)
        self.lower, self.upper, self.tolerance = lower, upper, tolerance

    def fit_features(self, df: DataFrame) -> TemperatureScaling:
        d = self._known(df).select(V.doubles(self.logits).alias(self.logits), F.col(self.label).cast("int").alias(self.label)).persist()
        try:
            low, high = np.log(self.lower), np.log(self.upper)
            while high - low > self.tolerance:
                grid = np.linspace(low, high, 17)
                losses = cross_entropy_at(d, self.logits, self.label, np.exp(grid).tolist())
                if losses[0] is None:
                    raise ValueError("no rows with known labels")
                best = int(np.argmin(losses))
                low, high = grid[max(0, best - 1)], grid[min(16, best + 1)]
            self.t, self.fitted = float(np.exp((low + high) / 2)), True
        finally:
            d.unpersist()
        return self


class ODIN(Detector):
    """A step on the input against the loss of the predicted class, then MaxSoftmax of the new logits at temperature 1.

    With a small linear head the gradient of the loss (the negative tempered logit of the winner) is known in closed form,
    so the whole detector is an expression. A larger head, or a ``head`` of several layers, goes forward and back in Arrow
    batches. Any other model takes ``gradient``, a DataFrame function that adds the column ``gradient`` to the inputs, and
    ``model``, which turns inputs into logits.

    ``target`` names a column of class numbers whose logit is raised in place of the winner's; with ``temperature`` the loss is
    the cross entropy at that temperature instead of the plain negative logit. Both need a head.
    """

    def __init__(self, model=None, *, weights=None, bias=None, head: H.Head | None = None, gradient: Callable[[DataFrame], DataFrame] | None = None, eps: float = 0.05, norm_std=None, target: str | None = None, temperature: float | None = None, **columns) -> None:
        super().__init__(model, **columns)
        self.weights, self.bias, self.gradient, self.eps, self.norm_std = weights, bias, gradient, eps, norm_std
        self.head, self.target, self.temperature = head, target, temperature
        if head is None and weights is not None and (np.size(weights) > V.MAX_LITERALS or target or temperature):
            self.head = H.linear_head(weights, bias)
        if (target or temperature) and self.head is None:
            raise ValueError("target and temperature need a head")

    def _moved(self) -> Column:
        head, eps, std, t = self.head, self.eps, self.norm_std, self.temperature

        def move(z: np.ndarray, *label: np.ndarray) -> np.ndarray:
            if t is not None:
                return H.stepped(z, head.likelihood_gradient(z, label[0] if label else head.forward(z).argmax(1), t), eps, std)
            if not label:
                return H.stepped(z, -head.winner_gradient(z), eps, std)
            classes = len(head.forward(z[:1])[0])
            return H.stepped(z, head.gradient(z, lambda _: -np.eye(classes)[label[0].astype(np.int64)]), eps, std)

        return H.batched("array<double>", move)(V.doubles(self.features), *([F.col(self.target)] if self.target else []))

    def perturbed(self, df: DataFrame) -> DataFrame:
        if self.head is not None:
            return df.withColumn(self.features, self._moved())
        if self.gradient is None:
            return df.withColumn(self.features, S.odin_linear(self.features, self.weights, self.bias, eps=self.eps, norm_std=self.norm_std))
        std = F.lit(1.0) if self.norm_std is None else V.literal(self.norm_std)
        d = self.gradient(df)
        step = F.transform("gradient", lambda g: F.signum(g) * F.lit(-float(self.eps)))
        if self.norm_std is not None:
            step = F.zip_with(step, std, lambda s, k: s / k)
        return d.withColumn(self.features, F.zip_with(V.doubles(self.features), step, lambda v, s: v + s)).drop("gradient")

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_features(df)

    __call__ = predict

    def predict_features(self, df: DataFrame) -> DataFrame:
        moved = self.perturbed(df)
        if self.model is not None:
            return self.model(moved).withColumn(self.score, S.max_softmax(self.logits))
        if self.head is not None:
            return moved.withColumn(self.score, S.max_softmax(H.batched("array<double>", self.head.forward)(F.col(self.features))))
        return moved.withColumn(self.score, S.max_softmax(V.linear(self.features, self.weights, self.bias)))


class MCD(Detector):
    """Monte-Carlo dropout in front of a linear head: ``mode`` "var" (mean over classes of the variance over passes) or "mean".

    Dropout masks are a function of row id, pass and dimension, so passes are the same on every partitioning. All passes
    of a row are computed in its own projection: nothing is exploded or shuffled. A head of more than ``V.MAX_LITERALS``
    weights, or a ``head`` of several layers with its own dropout layers (batch normalisation stays in evaluation mode), runs in
    Arrow batches with the same masks; only running moments are kept, so memory doesn't grow with the passes.
    """

    def __init__(self, *, weights=None, bias=None, head: H.Head | None = None, samples: int = 30, mode: str = "var", dropout: float = 0.5, row_id: str = "id", drop: Callable[[Column, Column, Column], Column] | None = None, **columns) -> None:
        super().__init__(None, **columns)
        if mode not in ("var", "mean"):
            raise ValueError("mode must be var or mean")
        if mode == "var" and samples < 2:
            raise ValueError("the variance needs two samples at least")
        self.weights, self.bias, self.samples, self.mode, self.dropout, self.row_id = weights, bias, samples, mode, dropout, row_id
        self.drop = drop or (lambda row, n, d: V.unit_hash(row, n, d) < F.lit(float(dropout)))
        self.head = head
        if head is None and np.size(weights) > V.MAX_LITERALS:
            if drop is not None:
                raise ValueError(f"masks of your own need a head of {V.MAX_LITERALS} weights at most")
            self.head = H.Head([H.Dropout(dropout), *H.linear_head(weights, bias).layers])

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_features(df)

    __call__ = predict

    def mean_probabilities(self) -> Column:
        """The mean softmax output over all passes, as an array."""
        head, samples = self._layered(), self.samples
        return H.batched("array<double>", lambda z, rows: head.passes(z, rows, samples)[0])(V.doubles(self.features), H.row_hash(self.row_id))

    def _layered(self) -> H.Head:
        return self.head or H.Head([H.Dropout(self.dropout), *H.linear_head(self.weights, self.bias).layers])

    def _in_batches(self) -> Column:
        head, samples, mode = self._layered(), self.samples, self.mode

        def score(z: np.ndarray, rows: np.ndarray) -> np.ndarray:
            mean, spread = head.passes(z, rows, samples)
            return -mean.max(axis=1) if mode == "mean" else (spread / (samples - 1)).mean(axis=1)

        return H.batched("double", score)(V.doubles(self.features), H.row_hash(self.row_id))

    def score_column(self) -> Column:
        if self.head is not None:
            return self._in_batches()
        keep = 1.0 / (1.0 - self.dropout)
        z, row = V.doubles(self.features), F.col(self.row_id)

        def one_pass(n: Column) -> Column:
            masked = F.transform(z, lambda v, d: F.when(self.drop(row, n, d), 0.0).otherwise(v * F.lit(keep)))
            return V.softmax(V.linear(masked, self.weights, self.bias))

        passes = F.transform(F.sequence(F.lit(1), F.lit(self.samples)), one_pass)
        classes = F.sequence(F.lit(0), F.lit(len(np.asarray(self.bias)) - 1))

        def variance(values: Column) -> Column:
            m = V.mean(values)
            return V.let(m, lambda m: F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.lit(float(self.samples - 1)))

        def over_classes(p: Column) -> Column:
            columns = F.transform(classes, lambda c: F.transform(p, lambda one: F.get(one, c)))
            if self.mode == "mean":
                return -F.array_max(F.transform(columns, V.mean))
            return V.let(F.transform(columns, variance), V.mean)

        return V.let(passes, over_classes)


class _Shaped(Detector):
    """Activations are shaped, go through a linear head, and a logit score follows."""

    def __init__(self, backbone=None, *, weights, bias, detector: Callable[[Column], Column] = S.energy, **columns) -> None:
        super().__init__(backbone, **columns)
        self.weights, self.bias, self.detector = weights, bias, detector

    def shaped(self) -> Column:
        raise NotImplementedError

    def shaped_rows(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same as :meth:`shaped` for the rows of a matrix."""
        raise NotImplementedError

    def head_weights(self) -> np.ndarray:
        return self.weights

    def logit_column(self) -> Column:
        """Logits of the shaped activations: an expression, or a step on Arrow batches if the head is large."""
        if np.size(self.weights) <= V.MAX_LITERALS:
            return V.linear(self.shaped(), self.head_weights(), self.bias)
        shape, head = self.shaped_rows(), H.linear_head(self.head_weights(), self.bias)

        def logits(z: np.ndarray) -> list:
            out = head.forward(shape(z))
            return [None if bad else row for row, bad in zip(out, np.isnan(out).any(axis=1))]

        return H.batched("array<double>", logits)(V.doubles(self.features))

    def score_column(self) -> Column:
        return self.detector(self.logit_column())


class ASH(_Shaped):
    """Activation shaping: ``variant`` ash-s, ash-b or ash-p."""

    VARIANTS = {"ash-s": S.ash_s, "ash-b": S.ash_b, "ash-p": S.ash_p}

    def __init__(self, backbone=None, *, variant: str = "ash-s", percentile: float = 0.65, **kwargs) -> None:
        super().__init__(backbone, **kwargs)
        if variant not in self.VARIANTS:
            raise ValueError(f"variant must be one of {sorted(self.VARIANTS)}")
        self.variant, self.percentile = variant, percentile

    def shaped(self) -> Column:
        return self.VARIANTS[self.variant](self.features, self.percentile)

    def shaped_rows(self) -> Callable[[np.ndarray], np.ndarray]:
        percentile, variant = self.percentile, self.variant
        return lambda z: H.shaped(z, percentile, variant)


class ReAct(_Shaped):
    """Activations are clipped from above."""

    def __init__(self, backbone=None, *, threshold: float = 1.0, **kwargs) -> None:
        super().__init__(backbone, **kwargs)
        self.threshold = threshold

    def shaped(self) -> Column:
        return S.react(self.features, self.threshold)

    def shaped_rows(self) -> Callable[[np.ndarray], np.ndarray]:
        threshold = self.threshold
        return lambda z: np.minimum(z, threshold)


class DICE(_Shaped):
    """Only the weights with the largest mean contribution stay; ``p`` is a percentile on 0..100."""

    needs_fit = True

    def __init__(self, model=None, *, p: float = 90.0, **kwargs) -> None:
        super().__init__(model, **kwargs)
        self.p = p

    def fit_features(self, df: DataFrame) -> DICE:
        _, mean = vector_mean(self._known(df), self.features)
        contribution = mean[None, :] * np.asarray(self.weights, np.float64)
        self.threshold = float(np.percentile(contribution, self.p))
        self.masked, self.fitted = np.where(contribution > self.threshold, self.weights, 0.0), True
        return self

    def shaped(self) -> Column:
        return V.doubles(self.features)

    def shaped_rows(self) -> Callable[[np.ndarray], np.ndarray]:
        return lambda z: z

    def head_weights(self) -> np.ndarray:
        return self.masked
