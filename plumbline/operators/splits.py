"""Open-set splits and benchmark tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS, curve_metrics, running_totals

#: Classes that a split can have; the roles are one small table.
MAX_CLASSES = 100_000


def class_roles(classes: Sequence[int], kuc: int, uuc_val: int, uuc_test: int, seed: int | None) -> dict[int, str]:
    """Role of each class from a seeded permutation (``seed`` None keeps the order): kuc, uuc_val, uuc_test, rest kkc."""
    order = list(classes) if seed is None else np.random.default_rng(seed).permutation(np.asarray(classes)).tolist()
    a, b, c = kuc, kuc + uuc_val, kuc + uuc_val + uuc_test
    return {k: "kuc" if i < a else "uuc_val" if i < b else "uuc_test" if i < c else "kkc" for i, k in enumerate(order)}


class OpenSetSplit:
    """Simulated open-set recognition: which classes are known, and which rows go to train, val and test.

    Known classes (kkc) and known unknown classes (kuc) are cut at ``floor(n * ratio)`` rows of a hashed order within
    each class; unknown unknown classes (uuc) go to val or test whole. Ranks come from range totals a class, so a class
    that holds most rows is no bottleneck. Rows with null labels are left out. Columns are carried in a struct; only ``role`` and
    ``stage`` of the input are replaced.
    """

    def __init__(self, df: DataFrame, *, label: str = "label", row_id: str = "id", kuc: int = 0, uuc_val: int = 0, uuc_test: int = 0, train: float = 0.8, val: float = 0.1, seed: int | None = 0, order: Column | None = None) -> None:
        classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        if kuc + uuc_val + uuc_test > len(classes):
            raise ValueError("more unknown classes than classes")
        self.label, self.row_id = label, row_id
        self.roles = class_roles(sorted(classes), kuc, uuc_val, uuc_test, seed)
        order = F.xxhash64(F.lit(seed or 0), F.col(row_id)).cast("double") if order is None else order
        role = F.try_element_at(F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]), F.col(label)) if self.roles else F.lit(None)
        known = df.where(F.col(label).isNotNull())
        d = known.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(label).alias("class"), F.col(row_id).alias("tie"), role.alias("role"), order.alias("order"), F.lit(1).cast("bigint").alias("one"))
        d = running_totals(d, "order", ["one"], by=["class"], ranges=16, descending=False, ties=["tie"], once=False)
        n, rank = F.col("all_one"), F.col("cum_one")
        n_train, n_val = F.floor(n * F.lit(float(train))), F.floor(n * F.lit(float(val)))
        stage = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
        stage = F.when(F.col("role") == "uuc_val", "val").when(F.col("role") == "uuc_test", "test").otherwise(stage)
        own = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ("role", "stage")]
        self.rows = d.select(*own, F.regexp_replace("role", "_.*", "").alias("role"), stage.alias("stage"))

    def classes_of(self, role: str) -> list[int]:
        return sorted(k for k, r in self.roles.items() if r.split("_")[0] == role)

    @property
    def kkc(self) -> list[int]:
        return self.classes_of("kkc")

    @property
    def kuc(self) -> list[int]:
        return self.classes_of("kuc")

    @property
    def uuc(self) -> list[int]:
        return self.classes_of("uuc")

    def stage(self, name: str, *, known: bool = True, unknown: bool = True) -> DataFrame:
        """Rows of a stage; unknown classes get labels below zero, known ones 0, 1, ... in ascending order."""
        if name not in ("train", "val", "test"):
            raise ValueError("stage must be train, val or test")
        to = {k: i for i, k in enumerate(self.kkc)} | {k: -1 - i for i, k in enumerate(self.kuc + self.uuc)}
        target = F.try_element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), F.col(self.label))
        d = self.rows.where(F.col("stage") == name).withColumn("target", target)
        if not known:
            d = d.where("role <> 'kkc'")
        return d if unknown else d.where("role = 'kkc'")

    def train_dataset(self, **which) -> DataFrame:
        return self.stage("train", **which)

    def val_dataset(self, **which) -> DataFrame:
        return self.stage("val", **which)

    def test_dataset(self, **which) -> DataFrame:
        return self.stage("test", **which)


class Benchmark:
    """One in-distribution test table against several outlier tables, scored and measured in one plan.

    The inlier rows are scored once and joined to every dataset's metric by replicating their score counts, not rows:
    each dataset's group holds the counts of its own outliers and of all inliers.
    """

    def __init__(self, test: DataFrame, outliers: Mapping[str, DataFrame], train: DataFrame | None = None, label: str = "label") -> None:
        self.test, self.outliers, self.train, self.label = test, dict(outliers), train, label

    def train_set(self) -> DataFrame:
        if self.train is None:
            raise ValueError("this benchmark has no training table")
        return self.train

    def test_sets(self, known: bool = True, unknown: bool = True) -> dict[str, DataFrame]:
        """Per dataset its outliers (labelled -1), its inliers, or both."""
        if not known and not unknown:
            raise ValueError("known or unknown must be true")
        out = {}
        for name, df in self.outliers.items():
            far = df.withColumn(self.label, F.lit(-1))
            out[name] = self.test.unionByName(far) if known and unknown else self.test if known else far
        return out

    def evaluate(self, detector: Callable[[DataFrame], DataFrame], score: str = "score") -> DataFrame:
        """(Dataset, AUROC, AUPR-IN, AUPR-OUT, FPR95TPR), one row a dataset."""
        names = F.array(*[F.lit(n) for n in self.outliers])
        rows = detector(self.test).groupBy(score).agg(F.count("*").alias("_n")).select(score, "_n", F.lit(0).alias(self.label), F.explode(names).alias("Dataset"))
        for name, df in self.outliers.items():
            far = detector(df.withColumn(self.label, F.lit(-1))).groupBy(score).agg(F.count("*").alias("_n"))
            rows = rows.unionByName(far.select(score, "_n", F.lit(-1).alias(self.label), F.lit(name).alias("Dataset")))
        return weighted_metrics(rows, score, self.label, "_n", by=["Dataset"])


def weighted_metrics(counts: DataFrame, score: str, label: str, count: str, by: Sequence[str]) -> DataFrame:
    """Metrics from pre-counted scores: each row stands for ``count`` rows."""
    far = F.col(label) < 0
    n = F.col(count)
    steps = counts.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(F.when(far, n).otherwise(0)).alias("p"), F.sum(F.when(far, 0).otherwise(n)).alias("n"))
    return curve_metrics(steps, by)


def mean_by_detector(results: DataFrame, detector: str = "Detector") -> DataFrame:
    """Mean of each metric over datasets, one row a detector, best AUROC last."""
    return results.groupBy(detector).agg(*[F.avg(f"`{m}`").alias(m) for m in METRICS]).orderBy("AUROC")


__all__ = ["Benchmark", "OpenSetSplit", "class_roles", "mean_by_detector", "weighted_metrics"]
