"""Outlier scores of one row as column expressions; larger means more outlying. None of them shuffles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .vectors import Vector


def _tempered(logits: Vector, t: float) -> Column:
    return V.doubles(logits) if t == 1.0 else V.scaled(V.doubles(logits), 1.0 / t)


def max_softmax(logits: Vector, t: float = 1.0) -> Column:
    """Minus the largest softmax probability: 1 / sum(exp(l - max))."""

    def score(x: Column) -> Column:
        return V.let(F.array_max(x), lambda m: -F.lit(1.0) / F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m)))

    return V.let(_tempered(logits, t), score)


def max_logit(logits: Vector) -> Column:
    return -F.array_max(V.doubles(logits))


def energy(logits: Vector, t: float = 1.0) -> Column:
    return V.logsumexp(_tempered(logits, t)) * F.lit(-float(t))


def weighted_energy(logits: Vector, weights) -> Column:
    """``-log sum relu(w_i) exp(l_i)``, shifted by the maximum; null if no weight is positive."""
    w = weights if isinstance(weights, Column) else V.literal(weights)

    def score(x: Column, m: Column) -> Column:
        return -(m + F.log(V.total(F.zip_with(x, w, lambda v, k: F.greatest(k, F.lit(0.0)) * F.exp(v - m)))))

    return V.let(V.doubles(logits), lambda x: V.let(F.array_max(x), lambda m: score(x, m)))


def entropy(logits: Vector) -> Column:
    """Entropy of the softmax; log p is ``l - logsumexp``, so a vanishing p adds nothing."""
    return -F.aggregate(V.log_softmax(V.doubles(logits)), F.lit(0.0), lambda s, lp: s + F.exp(lp) * lp)


def objectosphere(logits: Vector) -> Column:
    """Largest probability times the norm of the logits, negated."""
    return max_softmax(logits) * V.norm(V.doubles(logits))


def class_anchor(distances: Vector) -> Column:
    """``-max(d * (1 - softmin(d)))`` for distances to class anchors."""
    return V.let(V.doubles(distances), lambda d: -F.array_max(F.zip_with(d, V.softmin(d), lambda x, p: x * (F.lit(1.0) - p))))


def kl_divergence(p: Vector, q: Vector) -> Column:
    """KL(p || q); entries of p that are 0 add nothing, entries of q are bounded away from 0."""
    tiny = F.lit(1e-300)
    return V.total(F.zip_with(V.col(p), V.col(q), lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(F.greatest(b, tiny)))).otherwise(0.0)))


def odin_linear(x: Vector, weights: np.ndarray, bias: np.ndarray, *, eps: float = 0.05, norm_std=None) -> Column:
    """One step on the input of a linear head that raises the winning logit: ``x + eps * sign(w_winner) / std``."""
    z = V.doubles(x)
    step = np.sign(np.asarray(weights, np.float64))
    if norm_std is not None:
        step = step / np.asarray(norm_std, np.float64)
    winner = V.argmax(V.linear(z, weights, bias))
    return F.zip_with(z, F.element_at(V.literal(step), winner + 1), lambda v, s: v + F.lit(float(eps)) * s)


# ---------------------------------------------------------------- activation shaping


def react(features: Vector, threshold: float = 1.0) -> Column:
    return V.clipped(V.doubles(features), high=threshold)


def _shaped(features: Vector, percentile: float, value) -> Column:
    """The k largest entries survive as ``value(v, before, after, k)``, the rest become 0; k = n - round(n p), half to even.

    The k-th largest value decides, and positions decide among entries equal to it. before and after are the sums of
    all and of the surviving entries; the sorted array gives all of it at once.
    """

    def shape(x: Column, ranked: Column, k: Column) -> Column:
        cut, before, after = F.get(ranked, k - 1), V.total(x), V.total(F.slice(ranked, 1, k))

        def keep(cut: Column, before: Column, after: Column) -> Column:
            ties = F.filter(F.transform(x, lambda v, i: F.when(v == cut, i)), lambda i: i.isNotNull())
            wanted = k - F.size(F.filter(x, lambda v: v > cut))
            last = F.element_at(ties, wanted)
            return V.let(last, lambda at: F.transform(x, lambda v, i: F.when((v > cut) | ((v == cut) & (i <= at)), value(v, before, after, k)).otherwise(0.0)))

        return V.let(cut, lambda c: V.let(before, lambda s1: V.let(after, lambda s2: keep(c, s1, s2))))

    def begin(x: Column) -> Column:
        k = (F.size(x) - F.bround(F.size(x) * F.lit(float(percentile)), 0)).cast("int")
        none = F.transform(x, lambda v: F.lit(0.0))
        return V.let(k, lambda k: F.when(k > 0, V.let(F.sort_array(x, asc=False), lambda r: shape(x, r, k))).otherwise(none))

    return V.let(V.doubles(features), begin)


def ash_p(features: Vector, percentile: float = 0.65) -> Column:
    """Keep the largest activations, set the rest to 0."""
    return _shaped(features, percentile, lambda v, before, after, k: v)


def ash_b(features: Vector, percentile: float = 0.65) -> Column:
    """Keep the largest activations, each set to the sum of all activations over their number."""
    return _shaped(features, percentile, lambda v, before, after, k: before / k)


def ash_s(features: Vector, percentile: float = 0.65) -> Column:
    """Keep the largest activations and scale them by exp(sum before / sum after)."""
    return _shaped(features, percentile, lambda v, before, after, k: v * F.exp(F.try_divide(before, after)))
