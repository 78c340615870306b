"""Values of outlier-aware training losses: one expression a row, then a reduction.

Row losses are columns and keep every row; ``reduced`` turns one into a mean or a sum. Losses that mix reductions are
aggregates and take a DataFrame. Without any row of a side its mean is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors as V
from ..functions.vectors import Vector, col


def reduced(loss: Column, reduction: str | None = "mean") -> Column:
    """``mean`` and ``sum`` are aggregates, ``none`` leaves one value a row."""
    if reduction == "mean":
        return F.avg(loss)
    if reduction == "sum":
        return F.sum(loss)
    if reduction in ("none", None):
        return loss
    raise ValueError("reduction must be mean, sum or none")


def _zero() -> Column:
    return F.lit(0.0)


def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _known(label: Vector) -> Column:
    return col(label) >= 0


def _at(values: Column, label: Vector) -> Column:
    """The entry of the row's label; null for labels outside."""
    return F.get(values, col(label).cast("int"))


def _nll(logits: Column, label: Vector) -> Column:
    return V.logsumexp(logits) - _at(logits, label)


# ---------------------------------------------------------------- row losses


def cross_entropy(logits: Vector, label: Vector) -> Column:
    """0 for unknown rows, which stay in a mean's denominator."""
    return F.when(_known(label), _nll(V.doubles(logits), label)).otherwise(_zero())


def background_class(logits: Vector, label: Vector, n_classes: int) -> Column:
    """Cross-entropy over one more class, which unknown rows belong to; labels beyond the classes raise."""
    bad = F.raise_error(F.concat(F.lit("label too large: "), col(label).cast("string"))).cast("int")
    target = F.when(col(label) >= n_classes, bad).when(_known(label), col(label).cast("int")).otherwise(n_classes)
    return _nll(V.doubles(logits), target)


def _uniform(logits: Column) -> Column:
    return V.logsumexp(logits) - V.mean(logits)


def outlier_exposure(logits: Vector, label: Vector, alpha: float = 0.5) -> Column:
    x = V.doubles(logits)
    return F.when(_known(label), _nll(x, label)).otherwise(F.lit(float(alpha)) * _uniform(x))


def entropic_open_set(logits: Vector, label: Vector) -> Column:
    x = V.doubles(logits)
    return F.when(_known(label), _nll(x, label)).otherwise(_uniform(x))


def objectosphere(logits: Vector, features: Vector, label: Vector, alpha: float = 1.0, xi: float = 1.0) -> Column:
    size = V.norm(V.doubles(features))
    gap = _relu(F.lit(float(xi)) - size)
    return entropic_open_set(logits, label) + F.lit(float(alpha)) * F.when(_known(label), gap * gap).otherwise(size * size)


def energy_regularised(logits: Vector, label: Vector, alpha: float = 1.0, margin_in: float = -1.0, margin_out: float = -1.0) -> Column:
    e = S.energy(logits)
    above, below = _relu(e - F.lit(float(margin_in))), _relu(F.lit(float(margin_out)) - e)
    return cross_entropy(logits, label) + F.lit(float(alpha)) * F.when(_known(label), above * above).otherwise(below * below)


def center(distances: Vector, label: Vector, radius: float = 0.0) -> Column:
    """Mean over classes of the masked, clamped distance; null for unknown rows, so that means ignore them."""
    d = V.doubles(distances)
    low = F.lit(1e-12)
    own = F.least(F.greatest(_relu(_at(d, label) - F.lit(float(radius))), low), F.lit(1e12))
    n = F.size(d).cast("double")
    return F.when(_known(label), (own + (n - 1) * low) / n)


def class_anchor(distances: Vector, label: Vector, alpha: float = 1.0, *, exact: bool = False) -> Column:
    """Anchor plus tuplet term; null for unknown rows. The other classes are all but the last, as published; with
    ``exact`` they are all but the row's own."""

    def loss(d: Column, own: Column) -> Column:
        if exact:
            other = F.filter(F.transform(d, lambda v, i: F.when(i != col(label).cast("int"), v)), lambda v: v.isNotNull())
        else:
            other = F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))
        tuplet = F.aggregate(other, F.lit(0.0), lambda s, v: s + F.exp(F.least(own - v, F.lit(50.0))))
        return F.lit(float(alpha)) * own + F.log1p(tuplet)

    return F.when(_known(label), V.let(V.doubles(distances), lambda d: V.let(_at(d, label), lambda own: loss(d, own))))


def center_regularisation(distances: Vector, label: Vector, margin: float) -> Column:
    """Unknown rows: sum over classes of relu(margin^2 - d^2), where d is a squared distance already; known rows: null."""
    m = F.lit(float(margin) ** 2)
    return F.when(~_known(label), F.aggregate(V.doubles(distances), F.lit(0.0), lambda s, v: s + _relu(m - v * v)))


def deep_svdd(x: Vector, center_vector, label: Vector | None = None, radius: float = 0.0) -> Column:
    """relu(squared distance - radius^2), 0 for unknown rows; without labels every row counts."""
    c = center_vector if isinstance(center_vector, Column) else V.literal(center_vector)
    loss = _relu(V.sqdist(V.doubles(x), c) - F.lit(float(radius) ** 2))
    return loss if label is None else F.when(_known(label), loss).otherwise(_zero())


def semi_supervised_svdd(x: Vector, center_vector, label: Vector) -> Column:
    c = center_vector if isinstance(center_vector, Column) else V.literal(center_vector)
    d = V.sqdist(V.doubles(x), c)
    return F.when(_known(label), d * d).otherwise(F.try_divide(F.lit(1.0), d * d))


def logistic_energy(logits: Vector, label: Vector, class_weights, weight: tuple[float, float], bias: tuple[float, float]) -> Column:
    """Cross-entropy of a two-logit unit on the weighted energy: known rows are class 1, unknown rows class 0."""
    e = S.weighted_energy(logits, class_weights)
    return V.let(F.array(*[F.lit(float(w)) * e + F.lit(float(b)) for w, b in zip(weight, bias)]), lambda pair: _two_way(pair, label))


def _two_way(pair: Column, label: Vector) -> Column:
    return V.logsumexp(pair) - F.when(_known(label), F.get(pair, F.lit(1))).otherwise(F.get(pair, F.lit(0)))


def vos_regularised(logits: Vector, label: Vector, class_weights, weight, bias, alpha: float = 0.1) -> Column:
    return cross_entropy(logits, label) + F.lit(float(alpha)) * logistic_energy(logits, label, class_weights, weight, bias)


# ---------------------------------------------------------------- losses with reductions of their own


def confidence_loss(df: DataFrame, logits: str, confidence: str, label: str, alpha: float = 1.0, eps: float = 1e-24) -> DataFrame:
    """Sum over known rows of the hinted negative log-likelihood plus ``alpha`` times the mean over all rows of -log c;
    0 without known rows."""
    c, p = F.col(confidence).cast("double"), _at(V.softmax(V.doubles(logits)), label)
    hinted = -F.log(F.greatest(F.least(c * p + F.lit(1.0) - c, F.lit(1.0)), F.lit(float(eps))))
    sure = -F.log(F.greatest(F.least(c, F.lit(1.0)), F.lit(float(eps))))
    got = df.agg(F.sum(F.when(_known(label), hinted)).alias("nll"), F.avg(sure).alias("conf"))
    return got.select(F.coalesce(F.col("nll") + F.lit(float(alpha)) * F.col("conf"), _zero()).alias("loss"))


def energy_segmentation(df: DataFrame, logits: str, label: str, alpha: float = 1.0, margin_in: float = -1.0, margin_out: float = -1.0) -> DataFrame:
    """Mean cross-entropy of pixels plus ``alpha`` times the sum of two means; the energy of unknown pixels is taken of
    ``margin_out - logits``, as published."""
    x = V.doubles(logits)
    inside = _relu(S.energy(x) - F.lit(float(margin_in)))
    outside = _relu(S.energy(F.transform(x, lambda v: F.lit(float(margin_out)) - v)))
    got = df.agg(
        F.avg(cross_entropy(logits, label)).alias("ce"),
        F.avg(F.when(_known(label), inside * inside)).alias("a"),
        F.avg(F.when(~_known(label), outside * outside)).alias("b"),
    )
    return got.select((F.col("ce") + F.lit(float(alpha)) * (F.coalesce("a", _zero()) + F.coalesce("b", _zero()))).alias("loss"))


def ii_loss(df: DataFrame, features: str, label: str, alpha: float = 1.0, centers: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Mean squared distance to the own class mean minus ``alpha`` times the smallest squared distance of two means.

    Both come from per-class sums, so one pass over the rows is enough when ``centers`` are the classes' own means.
    """
    from .moments import class_means

    d = df.where(_known(label))
    stats = class_means(d, features, label)
    spark = df.sparkSession
    if not stats:
        return spark.createDataFrame([(0.0,)], "loss double")
    mu = {k: m for k, (_, m) in stats.items()} if centers is None else {k: centers[k] for k in stats}
    table = F.create_map(*[x for k, v in sorted(mu.items()) for x in (F.lit(k), V.literal(v))])
    keys = sorted(mu)
    gaps = [float(((mu[a] - mu[b]) ** 2).sum()) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    apart = min(gaps, default=1e24)
    own = V.sqdist(V.doubles(features), F.try_element_at(table, F.col(label).cast("int")))
    return d.agg((F.avg(own) - F.lit(float(alpha) * apart)).alias("loss"))


def mchad_loss(df: DataFrame, distances: str, label: str, *, radius: float = 0.0, margin: float = 1.0, weight_center: float = 1.0, weight_nll: float = 1.0, weight_oe: float = 1.0) -> DataFrame:
    """Weighted centre loss, cross-entropy of the negated distances, and the summed regularisation of unknown rows."""
    minus = V.scaled(V.doubles(distances), -1.0)
    got = df.agg(
        F.coalesce(F.avg(center(distances, label, radius)), _zero()).alias("c"),
        F.avg(cross_entropy(minus, label)).alias("n"),
        F.coalesce(F.sum(center_regularisation(distances, label, margin)), _zero()).alias("o"),
    )
    return got.select((F.lit(float(weight_center)) * F.col("c") + F.lit(float(weight_nll)) * F.col("n") + F.lit(float(weight_oe)) * F.col("o")).alias("loss"))


@dataclass
class Constraint:
    """``level <= limit`` in an augmented Lagrangian with multiplier m and penalty b.

    With g = level - limit its term is (max(0, m + b g)^2 - m^2) / 2b. A step moves the multiplier towards max(0, m + b g)
    at ``rate`` / b, and makes the penalty ``growth`` times larger while g is beyond ``slack``.
    """

    limit: float
    multiplier: float = 0.0
    penalty: float = 1.0

    def term(self, level: Column) -> Column:
        m, b = F.lit(self.multiplier), F.lit(self.penalty)
        reach = _relu(m + b * (level - F.lit(self.limit)))
        return (reach * reach - m * m) / (b * 2)

    def step(self, level: float, *, rate: float = 1.0, growth: float = 1.5, slack: float = 0.0) -> None:
        g, b = level - self.limit, self.penalty
        self.multiplier += rate * (max(0.0, self.multiplier + b * g) - self.multiplier) / b
        if g > slack:
            self.penalty = b * growth


class EnergyMarginLoss:
    """Mean sigmoid energy of unknown rows, under two constraints on the known ones: their mean sigmoid energy stays below
    the false-alarm cutoff, and their cross-entropy below ``tolerance`` times what training reached.

    The constraints' multipliers and penalties live on the driver; they are two numbers each.
    """

    def __init__(self, full_train_loss: float, *, eta: float = 1.0, false_alarm_cutoff: float = 0.05, tolerance: float = 2.0, weight_out: float = 1.0, alarms: Constraint | None = None, fit: Constraint | None = None) -> None:
        self.eta, self.weight_out = eta, weight_out
        self.alarms = alarms or Constraint(false_alarm_cutoff)
        self.fit = fit or Constraint(tolerance * full_train_loss)

    def levels(self, df: DataFrame, logits: str, label: str, weight: float, bias: float) -> DataFrame:
        """One row of means: alarms and fit over known rows, outside over unknown ones; ``weight`` and ``bias`` are the
        logistic unit on the log-sum-exp of the logits."""
        lse, known = V.logsumexp(V.doubles(logits)), _known(label)
        unit = lambda x: F.lit(float(weight)) * x + F.lit(float(bias))
        sigmoid = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
        return df.agg(
            F.avg(F.when(known, sigmoid(unit(lse)))).alias("alarms"),
            F.avg(F.when(known, _nll(V.doubles(logits), label))).alias("fit"),
            F.avg(F.when(~known, sigmoid(-unit(lse - F.lit(float(self.eta)))))).alias("outside"),
        )

    def loss(self, df: DataFrame, logits: str = "logits", label: str = "label", *, weight: float, bias: float) -> DataFrame:
        value = self.alarms.term(F.col("alarms")) + self.fit.term(F.col("fit")) + F.lit(self.weight_out) * F.col("outside")
        return self.levels(df, logits, label, weight, bias).select(value.alias("loss"))

    def step(self, df: DataFrame, logits: str = "logits", label: str = "label", *, weight: float, bias: float, **how) -> None:
        """Once an epoch, from one aggregate over the known training rows; ``how`` goes to :meth:`Constraint.step`."""
        row = self.levels(df, logits, label, weight, bias).first()
        self.alarms.step(row.alarms, **how)
        self.fit.step(row.fit, **how)
