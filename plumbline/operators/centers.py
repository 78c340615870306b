"""Class centres, distances to them, and queues of recent rows a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import heads as H
from ..functions import vectors as V
from .base import parameter_rows
from .moments import class_means, scatter, stacked, vector_sums

RIDGE = 1e-4


def class_center_table(df: DataFrame, features: str = "features", label: str = "label", n_classes: int | None = None) -> DataFrame:
    """(label, n, center): mean vector of each class; with ``n_classes`` absent classes get zeros."""
    sums = vector_sums(df.where(F.col(label) >= 0), features, label)
    entries = F.sort_array(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("m"))))
    table = sums.groupBy("key").agg(F.max("n").alias("n"), F.transform(entries, lambda e: e["m"]).alias("center"))
    table = table.select(F.col("key").cast("int").alias("label"), "n", "center")
    if n_classes is None:
        return table
    size = F.broadcast(table.agg(F.max(F.size("center")).alias("_d")))  # one row
    every = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label")).join(table, "label", "left").join(size)
    zeros = F.transform(F.sequence(F.lit(1), F.col("_d")), lambda _: F.lit(0.0))
    return every.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("center", zeros).alias("center"))


class ClassCenters:
    """Fixed centres, one row a class: distances, predictions and scores as expressions."""

    def __init__(self, centers: np.ndarray) -> None:
        self.centers = np.asarray(centers, np.float64)

    @classmethod
    def anchors(cls, n_classes: int, magnitude: float = 1.0) -> ClassCenters:
        """``magnitude`` times the unit vectors."""
        return cls(magnitude * np.eye(n_classes))

    @classmethod
    def estimate(cls, df: DataFrame, features: str = "features", label: str = "label", n_classes: int | None = None) -> ClassCenters:
        """Means of the known rows; absent classes get zeros."""
        got = class_means(df.where(F.col(label) >= 0), features, label)
        if not got:
            raise ValueError("no rows with known labels")
        dim = len(next(iter(got.values()))[1])
        return cls(np.stack([got[k][1] if k in got else np.zeros(dim) for k in range(n_classes or max(got) + 1)]))

    @property
    def n_classes(self) -> int:
        return len(self.centers)

    @property
    def n_features(self) -> int:
        return self.centers.shape[1]

    @property
    def _large(self) -> bool:
        """Whether the centres are more numbers than a plan should hold; ``x`` must then be a column and not a higher-order expression."""
        return self.centers.size > V.MAX_LITERALS

    def squared_distances(self, x: V.Vector) -> Column:
        if self._large:
            centers = self.centers
            return H.batched("array<double>", lambda z: H.center_distances(z, centers))(V.doubles(x))
        return V.let(V.doubles(x), lambda z: F.transform(V.literal(self.centers), lambda c: V.sqdist(z, c)))

    def distances(self, x: V.Vector) -> Column:
        if self._large:
            centers = self.centers
            return H.batched("array<double>", lambda z: np.sqrt(H.center_distances(z, centers)))(V.doubles(x))
        return V.let(V.doubles(x), lambda z: F.transform(V.literal(self.centers), lambda c: V.distance(z, c)))

    def predict(self, x: V.Vector) -> Column:
        """Class probabilities: softmin of the squared distances."""
        return V.softmin(self.squared_distances(x))

    def nearest(self, x: V.Vector) -> Column:
        """Distance to the nearest centre, an outlier score."""
        return F.sqrt(F.array_min(self.squared_distances(x)))


class RunningCenters:
    """Centres over batches: ``c <- (batch mean + c n) / (n + 1)``, where n counts all batches.

    Classes that a batch lacks keep their centre while n grows; never seen classes are NaN. A micro-batch stream folds
    through :meth:`update`; the state is C x D numbers.
    """

    def __init__(self, n_classes: int, n_features: int) -> None:
        self.n_classes, self.n_features = n_classes, n_features
        self.reset()

    def reset(self) -> None:
        self.centers = np.full((self.n_classes, self.n_features), np.nan)
        self.batches = 0

    def calculate(self, df: DataFrame, features: str = "features", label: str = "label") -> np.ndarray:
        out = np.full((self.n_classes, self.n_features), np.nan)
        for k, (_, m) in class_means(df.where(F.col(label) >= 0), features, label).items():
            out[k] = m
        return out

    def _fold(self, mu: np.ndarray) -> None:
        old = np.where(np.isnan(self.centers), 0.0, self.centers)
        self.centers = np.where(np.isnan(mu), self.centers, (mu + old * self.batches) / (self.batches + 1))
        self.batches += 1

    def update(self, df: DataFrame, features: str = "features", label: str = "label") -> np.ndarray:
        self._fold(self.calculate(df, features, label))
        return self.centers


def running_means(df: DataFrame, value: str, key: str, batch: str) -> DataFrame:
    """(key, center) after folding all batches (numbered from 0) of a scalar column as :class:`RunningCenters` does.

    Unrolled, a class's centre is a weighted sum of its batch means: batch b counts 1/(b+1), times (j/(j+1)) for every
    later batch j in which the class occurs. So it is one aggregate of batch means and one fold over their sorted list.
    """
    means = df.groupBy(key, batch).agg(F.avg(value).alias("m"))
    listed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(batch).cast("double").alias("b"), F.col("m").cast("double").alias("m")))).alias("l"))
    return listed.select(key, F.aggregate("l", F.lit(0.0), lambda c, e: (e["m"] + c * e["b"]) / (e["b"] + 1)).alias("center"))


def last_rows(df: DataFrame, key: str, sequence: str, n: int, *, salt: int = 32) -> DataFrame:
    """The last ``n`` rows of each key by ``sequence``. A hot key is cut down in ``salt`` parts first, by where rows are read, so that
    rows of one sequence value are spread too.

    Columns are carried in a struct, so their names never clash.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    group, latest = F.col(f"row.`{key}`"), F.col(f"row.`{sequence}`").desc()
    d = rows.withColumn("part", F.pmod(F.hash(f"row.`{sequence}`", F.spark_partition_id()), F.lit(salt)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group, "part").orderBy(latest))).where(F.col("rank") <= n)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(latest))).where(F.col("rank") <= n)
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def virtual_outliers(df: DataFrame, features: str = "features", label: str = "label", *, sample_from: int = 10_000, select: int = 1, seed: int = 0) -> DataFrame:
    """(label, rank, features): per class the ``select`` lowest-density of ``sample_from`` draws from its Gaussian.

    ``df`` holds the queued rows of each class (see :func:`last_rows`); unknown labels raise. The covariance is pooled
    with a small ridge. Every class draws in a task of its own, from a seed of its own.
    """
    if not df.where(F.col(label) < 0).isEmpty():
        raise ValueError("virtual outliers need known rows only")
    stats = class_means(df, features, label)
    n, s = scatter(df, features, {"pooled": {k: m for k, (_, m) in stats.items()}}, label)["pooled"]
    return _low_densities(df.sparkSession, {k: m for k, (_, m) in stats.items()}, s / n, sample_from, select, seed)


def _low_densities(spark: SparkSession, means: dict[int, np.ndarray], covariance: np.ndarray, sample_from: int, select: int, seed: int) -> DataFrame:
    root = np.linalg.cholesky(covariance + RIDGE * np.eye(len(covariance)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["label"]:
                rng = np.random.default_rng([seed, int(k)])
                e = rng.standard_normal((sample_from, len(root)))
                far = np.argsort(-(e * e).sum(1), kind="stable")[:select]
                yield pd.DataFrame({"label": k, "rank": range(1, len(far) + 1), "features": list(means[int(k)] + e[far] @ root.T)})

    classes = spark.createDataFrame([(int(k),) for k in sorted(means)], "label int")
    return classes.repartition(min(len(means), 200), "label").mapInPandas(draw, "label int, rank int, features array<double>")


#: Sums of queued rows: kind 0 has the sum of each class about an origin, 1 the products of all rows about it, 2 the origin.
SUMS = "kind int, key bigint, pos int, n bigint, x double"


def queue_sums(rows: DataFrame, origin: np.ndarray, sign: int) -> DataFrame:
    """SUMS of rows (label, z), kinds 0 and 1: one partial a task and class, with the sign of rows that enter (1) or leave (-1)."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product, many, total, count = 0.0, 0, {}, {}
        for f in frames:
            if len(f):
                z, y = stacked(f["z"]) - origin, f["label"].to_numpy()
                product, many = product + z.T @ z, many + len(z)
                for k in np.unique(y).tolist():
                    total[k] = total.get(k, 0) + z[y == k].sum(axis=0)
                    count[k] = count.get(k, 0) + int((y == k).sum())
        if many:
            yield pd.DataFrame({"kind": [0] * len(total) + [1], "key": [*total, 0], "n": [sign * c for c in count.values()] + [sign * many], "v": [sign * t for t in total.values()] + [sign * product.ravel()]})

    d = rows.select("label", "z").mapInPandas(partial, "kind int, key bigint, n bigint, v array<double>")
    return d.select("kind", "key", "n", F.posexplode("v").alias("pos", "x")).select("kind", "key", "pos", "n", "x")


def outliers_from_sums(sums: DataFrame, *, sample_from: int = 10_000, select: int = 1, seed: int = 0) -> DataFrame:
    """:func:`virtual_outliers` from SUMS in place of rows; classes whose rows all left are gone."""
    got = parameter_rows(sums.where("n > 0 OR kind = 2"))

    def of(kind: int) -> dict[int, tuple[int, np.ndarray]]:
        at = np.flatnonzero(got["kind"] == kind)
        at = at[np.lexsort((got["pos"][at], got["key"][at]))]
        return {int(k): (int(got["n"][i[0]]), got["x"][i]) for k, i in ((k, at[got["key"][at] == k]) for k in np.unique(got["key"][at]))}

    origin = of(2)[0][1]
    about = {k: (n, x / n) for k, (n, x) in of(0).items()}
    n, products = of(1)[0]
    within = products.reshape(len(origin), -1) - sum(c * np.outer(m, m) for c, m in about.values())
    return _low_densities(sums.sparkSession, {k: origin + m for k, (_, m) in about.items()}, within / n, sample_from, select, seed)


__all__ = ["ClassCenters", "RunningCenters", "class_center_table", "last_rows", "outliers_from_sums", "queue_sums", "running_means", "stacked", "virtual_outliers"]
