"""Evaluation of outlier scores: rank metrics, calibration, temperature. Outliers are the positive class."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..scratch import written

METRICS = ("AUROC", "AUPR-IN", "AUPR-OUT", "FPR95TPR")
#: Least and largest number of ranges that a global order is cut into, so that no single task orders all rows; between
#: them it follows from the number of shuffle partitions.
RANGES, MOST_RANGES = 64, 8192
#: Rows up to which a table of range totals is broadcast.
BROADCAST_ROWS = 100_000


def running_totals(df: DataFrame, order: str, sums: Sequence[str], *, by: Sequence[str] = (), ranges: int | None = None, descending: bool = True, ties: Sequence[str] = (), once: bool = True) -> DataFrame:
    """Add ``cum_<c>`` (running sum in the order, own row included) and ``all_<c>`` (sum of the group) for each column.

    Two phases: rows are cut into ranges of ``order`` (at percentiles of a summary, so the cuts only decide the balance),
    each range's totals give its offset, and a window inside each range gives the rest. Groups of ``by`` are cut at the same
    places, so a task has no more rows than a range, however large a group is. Equal values of the order stay together:
    count them before.

    Cuts, totals and windows each read ``df``, so it is written to the shared folder first; ``once=False`` leaves that out
    where reading it again is cheap.
    """
    by, key = list(by), F.col(order)
    if ranges is None:
        ranges = min(MOST_RANGES, max(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rank = F.lit(0)
    if once:
        df = written(df, "counts")
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = df.agg(F.percentile_approx(key, at, 4 * ranges).alias("c")).first().c
        cuts = sorted({float(c) for c in cuts or []})
        rank = V.rank_among(cuts, key)
    d = df.withColumn("_range", rank)
    totals = d.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sided = whole.orderBy(F.col("_range").desc() if descending else F.col("_range").asc())
    before = sided.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_range2"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # MOST_RANGES rows at most
    match = F.col("_range") == F.col("_range2")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    directed = [key.desc() if descending else key.asc(), *[F.col(t) for t in ties]]
    inside = Window.partitionBy(*by, "_range").orderBy(*directed).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(inside).alias(f"_w_{c}") for c in sums]).join(offsets, match)
    keep = [c for c in df.columns]
    return d.select(*[F.col(f"`{c}`") for c in keep], *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums], *[F.col(f"all_{c}") for c in sums])


def ood_metrics(df: DataFrame, score: str = "score", label: str = "label", *, by: Sequence[str] = (), void_label: int | None = None, ranges: int | None = None, on_missing: str = "raise") -> DataFrame:
    """AUROC, AUPR-IN, AUPR-OUT and FPR95TPR of scores, one row (or one for each group of ``by``).

    Rows of equal score are one step of the curves. A group that lacks one side raises when it is computed, or gives
    nulls with ``on_missing="null"``. No rows give no row. Scores are counted before anything is ordered, and one pass
    over the counts serves all four curves: the inlier curves are the outlier curves read from the other end.
    """
    by = list(by)
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    if void_label is not None:
        d = d.where(F.col(label) != void_label)
    out = (F.col(label) < 0).cast("bigint")
    steps = d.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(out).alias("p"), F.sum(1 - out).alias("n"))
    return curve_metrics(steps, by, ranges=ranges, on_missing=on_missing)


def curve_metrics(steps: DataFrame, by: Sequence[str] = (), *, ranges: int | None = None, on_missing: str = "raise") -> DataFrame:
    """The metrics from one row a distinct score: ``_s``, ``p`` (outliers) and ``n`` (inliers) at that score."""
    by = list(by)
    c = running_totals(steps, "_s", ["p", "n"], by=by, ranges=ranges)
    num = lambda x: F.col(x).cast("double")
    p, n, tp, fp, P, N = (num(x) for x in ("p", "n", "cum_p", "cum_n", "all_p", "all_n"))
    one, half = F.lit(1.0), F.lit(0.5)

    def precision(t: Column, f: Column) -> Column:
        return F.when(t + f > 0, t / (t + f)).otherwise(one)

    area = n * (tp + tp - p) * half
    pr_out = p * (precision(tp, fp) + precision(tp - p, fp - n)) * half
    pr_in = n * (precision(N - fp + n, P - tp + p) + precision(N - fp, P - tp)) * half
    reached = F.when(tp >= F.lit(0.95) * P, fp)
    got = c.groupBy(*by).agg(F.max("all_p").alias("_P"), F.max("all_n").alias("_N"), F.sum(area).alias("a"), F.sum(pr_in).alias("i"), F.sum(pr_out).alias("o"), F.min(reached).alias("f")).where("_P IS NOT NULL")
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    if on_missing == "raise":
        guard = F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("scores of both known and unknown rows are needed")).cast("boolean"))
    else:
        guard = both
    return got.select(
        *by,
        F.when(guard, F.col("a") / (num("_P") * num("_N"))).alias("AUROC"),
        F.when(guard, F.col("i") / num("_N")).alias("AUPR-IN"),
        F.when(guard, F.col("o") / num("_P")).alias("AUPR-OUT"),
        F.when(guard, F.col("f") / num("_N")).alias("FPR95TPR"),
    )


def segmentation_metrics(df: DataFrame, image: str = "image_id", *, on_missing: str = "raise", **kwargs) -> DataFrame:
    """Mean over images of the metrics of each image's pixels."""
    per = ood_metrics(df, by=[image], on_missing=on_missing, **kwargs)
    return per.agg(*[F.avg(f"`{m}`").alias(m) for m in METRICS])


class OODMetrics:
    """Collect scored tables, then compute; ``mode`` is classification or segmentation (one curve an image)."""

    def __init__(self, mode: str = "classification", void_label: int | None = None, image: str = "image_id", on_missing: str = "raise") -> None:
        if mode not in ("classification", "segmentation"):
            raise ValueError("mode must be classification or segmentation")
        self.mode, self.void_label, self.image, self.on_missing = mode, void_label, image, on_missing
        self.reset()

    def update(self, df: DataFrame, score: str = "score", label: str = "label") -> OODMetrics:
        extra = [F.col(self.image)] if self.mode == "segmentation" else []
        part = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label"), *extra)
        self._rows = part if self._rows is None else self._rows.unionByName(part)
        return self

    def compute(self) -> DataFrame:
        if self._rows is None:
            raise ValueError("nothing to compute: update first")
        if self.mode == "segmentation":
            return segmentation_metrics(self._rows, self.image, void_label=self.void_label, on_missing=self.on_missing)
        return ood_metrics(self._rows, void_label=self.void_label, on_missing=self.on_missing)

    def reset(self) -> None:
        self._rows: DataFrame | None = None


# ---------------------------------------------------------------- calibration


def _counted(df: DataFrame, confidence: str, correct: str, descending: bool) -> DataFrame:
    """Distinct (c, ok), wrong before right among equal confidences, with their number of rows, k, and running sums.

    Rows of equal confidence are counted first, so a value that very many rows have is one row here.
    """
    d = df.select(F.col(confidence).cast("double").alias("c"), F.col(correct).cast("double").alias("ok"))
    pairs = d.groupBy("c", "ok").agg(F.count("*").alias("k")).withColumn("right", F.col("k") * F.col("ok"))
    return running_totals(pairs, "c", ["k", "right"], descending=descending, ties=["ok"])


def calibration_error(df: DataFrame, confidence: str = "confidence", correct: str = "correct", *, p: str = "2", beta: int = 100) -> DataFrame:
    """Binned calibration error (column calibration_error): equal-count bins of ``beta`` rows by confidence.

    The last bin takes the remainder and is not evaluated, as in the published implementation. Fewer than ``beta`` rows
    raise. Among rows of equal confidence the wrong ones come first. Ranks come from counts of equal rows and range totals,
    never from one ordered task; a run of equal rows adds to each bin that it reaches into.
    """
    if p not in ("1", "2", "infty", "infinity", "max"):
        raise ValueError("p must be '1', '2' or 'infty'")
    r = _counted(df, confidence, correct, False)
    last = F.floor(F.col("all_k") / beta) - 1
    few = F.when(last < 0, F.raise_error(F.lit(f"fewer than {beta} rows")).cast("bigint")).otherwise(last)
    begin, end = F.col("cum_k") - F.col("k"), F.col("cum_k")
    r = r.select("c", "ok", begin.alias("begin"), end.alias("end"), F.col("all_k").alias("n"), few.alias("last"))
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / beta), F.floor((F.col("end") - 1) / beta)))).where(F.col("bin") < F.col("last"))
    k = F.least("end", (F.col("bin") + 1) * beta) - F.greatest("begin", F.col("bin") * beta)
    bins = r.withColumn("k", k).groupBy("bin").agg((F.sum(F.col("c") * F.col("k")) / F.sum("k")).alias("c"), (F.sum(F.col("ok") * F.col("k")) / F.sum("k")).alias("a"), F.sum("k").alias("k"), F.max("n").alias("n"))
    gap = F.abs(F.col("c") - F.col("a"))
    share = F.col("k").cast("double") / F.col("n").cast("double")
    if p == "1":
        value = F.sum(share * gap)
    elif p == "2":
        value = F.sqrt(F.sum(share * gap * gap))
    else:
        value = F.max(gap)
    return bins.agg(F.coalesce(value, F.lit(0.0)).alias("calibration_error"))


def _harmonic(k: Column, n: Column) -> Column:
    """1 / (k + 1) + ... + 1 / (k + n): term by term up to 64 of them or from small k, else by its series."""
    x, y = k.cast("double"), (k + n).cast("double")
    terms = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (x + j))
    tail = lambda v: F.lit(1.0) / (v * 2) - F.lit(1.0) / (v * v * 12) + F.lit(1.0) / (v * v * v * v * 120)
    series = lambda v: F.log1p((y - v) / v) + tail(y) - tail(v)
    first = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(64) - k), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (x + j))
    return F.when(n <= 64, terms).when(k >= 64, series(x)).otherwise(first + series(F.lit(64.0)))


def aurra(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Area under the response rate accuracy curve (column aurra): mean running accuracy, most confident first.

    Among rows of equal confidence the wrong ones come first. A run of n equal rows after k rows, s of them right, adds s
    or, if its rows are right, s - k times 1 / (k + 1) + ... + 1 / (k + n), and then n more.
    """
    r = _counted(df, confidence, correct, True)
    n, k, s = F.col("k"), F.col("cum_k") - F.col("k"), F.col("cum_right") - F.col("right")
    part = F.when(F.col("ok") > 0, n + (s - k) * _harmonic(k, n)).otherwise(s * _harmonic(k, n))
    return r.agg((F.sum(part) / F.sum("k")).alias("aurra"))


def openness(n_train: Column | int, n_test: Column | int, n_target: Column | int) -> Column:
    """``1 - sqrt(2 train / (test + target))``."""
    train, test, target = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (n_train, n_test, n_target))
    return F.lit(1.0) - F.sqrt(F.lit(2.0) * train / (test + target))


def _slopes(df: DataFrame, logits: str, label: str, temperatures: Sequence[float]) -> list[float]:
    """Mean derivative of the cross-entropy in T at each temperature: all of them in one pass."""

    def slope(t: float) -> Column:
        p = V.softmax(V.scaled(F.col(logits), 1.0 / t))
        own = F.element_at(F.col(logits), F.col(label) + 1)
        return F.avg((own - V.dot(p, F.col(logits))) / F.lit(t * t))

    row = df.agg(*[slope(t).alias(f"g{i}") for i, t in enumerate(temperatures)]).first()
    return list(row)


def cross_entropy_at(df: DataFrame, logits: str, label: str, temperatures: Sequence[float]) -> list[float]:
    def loss(t: float) -> Column:
        x = V.scaled(F.col(logits), 1.0 / t)
        return F.avg(V.logsumexp(x) - F.element_at(x, F.col(label) + 1))

    return list(df.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(temperatures)]).first())


def temperature_calibration(df: DataFrame, logits: str = "logits", label: str = "label", *, lower: float = 0.2, upper: float = 5.0, eps: float = 1e-4) -> float:
    """The temperature of the smallest cross-entropy by bisection on its slope, over rows with known labels.

    Each pass over the data evaluates the midpoints of the next four halvings, so 17 halvings take five passes.
    """
    d = df.where(F.col(label) >= 0).select(V.doubles(logits).alias(logits), F.col(label).cast("int").alias(label)).persist()
    try:
        while upper - lower > eps:
            mids = [lower + (upper - lower) * i / 16 for i in range(1, 16)]
            slope = _slopes(d, logits, label, mids)
            if slope[0] is None:
                raise ValueError("no rows with known labels")
            lo, hi = 0, 16
            while hi - lo > 1 and (upper - lower) * (hi - lo) / 16 > eps:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if slope[mid - 1] > 0 else (mid, hi)
            lower, upper = lower + (upper - lower) * lo / 16, lower + (upper - lower) * hi / 16
        options = [lower, (lower + upper) / 2, upper]
        losses = cross_entropy_at(d, logits, label, options)
        return options[int(np.argmin(losses))]
    finally:
        d.unpersist()


def energy_logistic_loss(df: DataFrame, logits: str = "logits", label: str = "label", *, weight: float, bias: float) -> DataFrame:
    """One row: mean sigmoid of the logistic unit on log-sum-exp energies, its mean cross-entropy against known (0) and
    the mean cross-entropy of the logits, over known rows."""
    e = V.logsumexp(V.doubles(logits)) * F.lit(float(weight)) + F.lit(float(bias))
    own = F.element_at(V.doubles(logits), F.col(label).cast("int") + 1)
    d = df.where(F.col(label) >= 0)
    return d.agg(
        F.avg(F.lit(1.0) / (F.lit(1.0) + F.exp(-e))).alias("sigmoid"),
        F.avg(F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))).alias("energy_bce"),
        F.avg(V.logsumexp(V.doubles(logits)) - own).alias("cross_entropy"),
    )
