"""Layered heads on Arrow batches: forward and reverse passes in numpy, for heads that are too large or deep for expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Array = np.ndarray


def batched(returns: str, body: Callable[..., Array]) -> Callable[..., Column]:
    """A column function of ``body`` over matrices (one row a vector) or plain values; rows with a null in them give null.

    Arguments should be columns, or casts of columns: Spark can't move a Python function whose arguments hold lambdas.
    """

    @pandas_udf(returns)
    def step(first: pd.Series, *rest: pd.Series) -> pd.Series:
        columns = (first, *rest)
        out = np.full(len(first), None, object)
        at = np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))
        if len(at):
            got = [c.to_numpy()[at] for c in columns]
            made = body(*[np.stack(v).astype(np.float64) if isinstance(v[0], np.ndarray) else v for v in got])
            for k, row in zip(at, made):
                out[k] = row
        return pd.Series(out)

    return step


def softmax(logits: Array) -> Array:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- Spark's xxhash64, so that masks equal those of expressions

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: Array, by: int) -> Array:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_int(value: Array, seed: Array) -> Array:
    """``xxhash64(..., int)`` where ``seed`` is the hash of the columns before it; all unsigned, with broadcasting."""
    h = (seed + _P5 + np.uint64(4)) ^ (value.astype(np.uint32).astype(np.uint64) * _P1)
    h = _rotated(h, 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def unit_interval(h: Array) -> Array:
    """As :func:`vectors.unit_hash` makes a number in (0, 1) of a hash."""
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


# ---------------------------------------------------------------- layers


@dataclass(frozen=True)
class Linear:
    weights: Array
    bias: Array

    def forward(self, x: Array) -> Array:
        return x @ np.asarray(self.weights, np.float64).T + np.asarray(self.bias, np.float64)

    def backward(self, x: Array, y: Array, dy: Array) -> Array:
        return dy @ np.asarray(self.weights, np.float64)


@dataclass(frozen=True)
class Tanh:
    def forward(self, x: Array) -> Array:
        return np.tanh(x)

    def backward(self, x: Array, y: Array, dy: Array) -> Array:
        return dy * (1 - y * y)


@dataclass(frozen=True)
class Relu:
    def forward(self, x: Array) -> Array:
        return np.maximum(x, 0)

    def backward(self, x: Array, y: Array, dy: Array) -> Array:
        return dy * (x > 0)


@dataclass(frozen=True)
class BatchNorm:
    """Batch normalisation in evaluation mode: fixed means and variances."""

    mean: Array
    variance: Array
    scale: Array
    shift: Array
    eps: float = 1e-5

    def _factor(self) -> Array:
        return np.asarray(self.scale, np.float64) / np.sqrt(np.asarray(self.variance, np.float64) + self.eps)

    def forward(self, x: Array) -> Array:
        return (x - np.asarray(self.mean, np.float64)) * self._factor() + np.asarray(self.shift, np.float64)

    def backward(self, x: Array, y: Array, dy: Array) -> Array:
        return dy * self._factor()


@dataclass(frozen=True)
class Dropout:
    """Active only in :meth:`Head.passes`; else rows go through as they are."""

    rate: float = 0.5

    def forward(self, x: Array) -> Array:
        return x

    def backward(self, x: Array, y: Array, dy: Array) -> Array:
        return dy


Layer = Linear | Tanh | Relu | BatchNorm | Dropout


class Head:
    """A list of layers from features to logits."""

    def __init__(self, layers: Sequence[Layer]) -> None:
        self.layers = tuple(layers)

    @property
    def numbers(self) -> int:
        """Weights in all linear layers."""
        return sum(np.size(x.weights) for x in self.layers if isinstance(x, Linear))

    def forward(self, x: Array) -> Array:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def gradient(self, x: Array, of: Callable[[Array], Array]) -> Array:
        """The gradient of a scalar of the outputs with respect to ``x``; ``of`` turns outputs into its gradient there."""
        values = [x]
        for layer in self.layers:
            values.append(layer.forward(values[-1]))
        d = of(values[-1])
        for k in range(len(self.layers) - 1, -1, -1):
            d = self.layers[k].backward(values[k], values[k + 1], d)
        return d

    def passes(self, x: Array, rows: Array, samples: int) -> tuple[Array, Array]:
        """Mean and sum of squared deviations of the softmax over ``samples`` passes with active dropout.

        The mask of a unit is a function of the row's hash, the pass, the unit, and the dropout layer beyond the first, so it
        doesn't depend on batches. Moments are updated a pass at a time: memory doesn't grow with the passes.
        """
        start, mean, spread = rows.astype(np.int64).view(np.uint64)[:, None], 0.0, 0.0
        for n in range(1, samples + 1):
            seed, z, k = hash_int(np.array([[n]]), start), x, 0
            for layer in self.layers:
                if isinstance(layer, Dropout):
                    h = hash_int(np.arange(z.shape[1])[None, :], seed)
                    h = hash_int(np.array([[k]]), h) if k else h
                    z = np.where(unit_interval(h) < layer.rate, 0.0, z * (1 / (1 - layer.rate)))
                    k += 1
                else:
                    z = layer.forward(z)
            p = softmax(z)
            step = p - mean
            mean = mean + step / n
            spread = spread + step * (p - mean)
        return mean, spread

    def winner_gradient(self, x: Array) -> Array:
        """The gradient of the largest logit."""

        def one(logits: Array) -> Array:
            d = np.zeros_like(logits)
            d[np.arange(len(d)), logits.argmax(1)] = 1
            return d

        return self.gradient(x, one)

    def likelihood_gradient(self, x: Array, label: Array, temperature: float = 1.0) -> Array:
        """The gradient of the cross entropy of given labels."""

        def one(logits: Array) -> Array:
            d = softmax(logits / temperature)
            d[np.arange(len(d)), label.astype(np.int64)] -= 1
            return d / temperature

        return self.gradient(x, one)


def linear_head(weights: Array, bias: Array) -> Head:
    return Head([Linear(np.asarray(weights, np.float64), np.asarray(bias, np.float64))])


def stepped(x: Array, gradient: Array, eps: float, norm_std=None) -> Array:
    """One signed step against ``gradient``, of ``eps`` over each entry's deviation."""
    step = np.sign(gradient)
    return x - eps * (step if norm_std is None else step / np.asarray(norm_std, np.float64))


# ---------------------------------------------------------------- activation shaping


def shaped(x: Array, percentile: float, variant: str) -> Array:
    """``ash-p``, ``ash-b`` or ``ash-s`` of each row; among equal entries at the cut the first positions stay."""
    size = x.shape[1]
    k = size - int(np.rint(size * percentile))
    if k <= 0:
        return np.zeros_like(x)
    kept = np.argsort(-x, axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(x, kept, axis=1)
    before, after = x.sum(axis=1, keepdims=True), values.sum(axis=1, keepdims=True)
    if variant == "ash-b":
        values = np.broadcast_to(before / k, values.shape)
    elif variant == "ash-s":
        with np.errstate(divide="ignore", invalid="ignore"):
            values = values * np.where(after == 0, np.nan, np.exp(before / after))
    out = np.zeros_like(x)
    np.put_along_axis(out, kept, values, axis=1)
    return out


def class_rows(table: dict[int, Array], classes: Array, missing: str) -> Array:
    """The fitted vector of each row's class; classes that were not fitted raise."""
    known = np.array(sorted(table))
    at = np.minimum(np.searchsorted(known, classes), len(known) - 1)
    lost = known[at] != classes
    if lost.any():
        raise ValueError(f"{missing}{int(classes[lost][0])}")
    return np.stack([table[int(k)] for k in known])[at]


def center_distances(z: Array, centers: Array) -> Array:
    """Squared distances to every centre by direct differences, a centre at a time."""
    return np.stack([((z - c) ** 2).sum(axis=1) for c in centers], axis=1)


def row_hash(row_id: str) -> Column:
    return F.xxhash64(F.col(f"`{row_id}`"))
