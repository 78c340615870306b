"""Vector expressions on ARRAY<DOUBLE> columns: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Vector = Column | str


def col(c: Vector) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: Vector) -> Column:
    return col(c).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: what a lambda captures is otherwise computed again for each entry."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(values: Sequence[float] | np.ndarray) -> Column:
    """A numeric vector (or a matrix, as an array of rows) as one constant that the optimizer folds."""
    a = np.asarray(values, dtype=np.float64)
    if a.ndim == 2:
        return F.array(*[literal(row) for row in a])
    return F.array(*[F.lit(float(v)) for v in a]) if len(a) else F.array().cast("array<double>")


def rank_among(cuts: Sequence[float], key: Column) -> Column:
    """How many of the ascending ``cuts`` are below ``key``, by halving: its cost grows with the logarithm of their number."""
    if not len(cuts):
        return F.lit(0)
    table = F.split(F.lit(",".join(repr(float(c)) for c in cuts)), ",").cast("array<double>")  # folds to one literal
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    halve = lambda at, step: at + F.when(F.get(table, at + step - 1) < key, step).otherwise(0)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), halve)


def total(c: Vector) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda s, v: s + v)


def dot(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def sqdist(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(sqdist(a, b))


def sqnorm(a: Vector) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v * v)


def norm(a: Vector) -> Column:
    return F.sqrt(sqnorm(a))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def mean(a: Vector) -> Column:
    return F.try_divide(total(a), F.size(col(a)).cast("double"))


def argmax(a: Vector) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def argmin(a: Vector) -> Column:
    return (F.array_position(col(a), F.array_min(col(a))) - 1).cast("int")


def scaled(a: Vector, factor: Column | float) -> Column:
    if isinstance(factor, int | float):
        return F.transform(col(a), lambda v: v * F.lit(float(factor)))
    return let(factor, lambda k: F.transform(col(a), lambda v: v * k))


def _lse(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))))


def logsumexp(a: Vector) -> Column:
    """Shifted by the maximum, so no finite input overflows."""
    return let(col(a), _lse)


def log_softmax(a: Vector) -> Column:
    return let(col(a), lambda x: let(_lse(x), lambda s: F.transform(x, lambda v: v - s)))


def softmax(a: Vector) -> Column:
    return F.transform(log_softmax(a), F.exp)


def softmin(a: Vector) -> Column:
    return softmax(scaled(a, -1.0))


#: Numbers of a weight matrix up to which it is part of the plan, as constants; larger ones multiply Arrow batches.
MAX_LITERALS = 4_096


def _product(weights: np.ndarray, bias: np.ndarray):
    @pandas_udf("array<double>")
    def product(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), None, object)
        at = np.flatnonzero(vectors.notna().to_numpy())
        if len(at):
            made = np.stack(vectors.to_numpy()[at]).astype(np.float64) @ weights.T + bias
            for k, row in zip(at, made):
                out[k] = row
        return pd.Series(out)

    return product


def linear(x: Vector, weights: np.ndarray | Column, bias: np.ndarray | Column) -> Column:
    """``W x + b`` with one output for each row of W."""
    if not isinstance(weights, Column) and not isinstance(bias, Column) and np.size(weights) > MAX_LITERALS:
        return _product(np.asarray(weights, np.float64), np.asarray(bias, np.float64))(doubles(x))
    w = weights if isinstance(weights, Column) else literal(weights)
    b = bias if isinstance(bias, Column) else literal(bias)
    return let(col(x), lambda z: F.zip_with(w, b, lambda row, c: dot(row, z) + c))


def channel_means(feature_map: Vector) -> Column:
    """ARRAY<ARRAY<DOUBLE>> (channels of positions) to one mean a channel."""
    return F.transform(col(feature_map), mean)


def flattened(feature_map: Vector) -> Column:
    return F.flatten(col(feature_map))


def normalised(pixels: Vector, means: Sequence[float], stds: Sequence[float]) -> Column:
    """Per-channel ``(x - mean) / std`` of an ARRAY<ARRAY<DOUBLE>> of channels."""
    stats = F.arrays_zip(literal(means).alias("m"), literal(stds).alias("s"))
    return F.zip_with(col(pixels), stats, lambda ch, st: F.transform(ch, lambda v: (v - st["m"]) / st["s"]))


#: Channel means and deviations, of 255, that published models of each training set expect.
NORMALISATION = {
    "cifar10": ((125.3, 123.0, 113.9), (63.0, 62.1, 66.7)),
    "cifar100": ((125.3, 123.0, 113.9), (63.0, 62.1, 66.7)),
    "imagenet32": ((127.5, 127.5, 127.5), (127.5, 127.5, 127.5)),
}


def normalisation_of(training_set: str) -> tuple[list[float], list[float]]:
    """(means, deviations) by channel, for values from 0 to 1."""
    if training_set not in NORMALISATION:
        raise ValueError(f"training set must be one of {tuple(NORMALISATION)}")
    return tuple([v / 255 for v in part] for part in NORMALISATION[training_set])


def clipped(a: Vector, low: float | None = None, high: float | None = None) -> Column:
    def one(v: Column) -> Column:
        v = v if low is None else F.greatest(v, F.lit(float(low)))
        return v if high is None else F.least(v, F.lit(float(high)))

    return F.transform(col(a), one)


def unit_hash(*keys: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the keys alone, so it is the same on every partitioning and retry."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def normal_hash(*keys: Column | str | int) -> Column:
    """A standard normal number from :func:`unit_hash` (Box-Muller)."""
    u, v = unit_hash(*keys, "u"), unit_hash(*keys, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * np.pi) * v)
