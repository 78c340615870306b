"""Sufficient statistics of vector columns: partials in every task, summed by key and position in a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.vectors import channel_means, doubles
from .base import parameter_rows


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _merged(partials: DataFrame) -> DataFrame:
    """(key, n, v) partials to (key, n, pos, x) sums; the shuffle gets one row a task, key and position at most."""
    long = partials.select("key", "n", F.posexplode("v").alias("pos", "x"))
    return long.groupBy("key", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def _keyed(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    got = parameter_rows(rows.select(F.col("key").cast("bigint"), "n", "pos", "x"))
    out = {}
    order = np.lexsort((got["pos"], got["key"]))
    keys, n, x = got["key"][order], got["n"][order], got["x"][order]
    for k in np.unique(keys):
        a, b = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
        out[int(k)] = (int(n[a]), x[a:b])
    return out


def vector_sums(df: DataFrame, vector: Column | str, key: Column | str) -> DataFrame:
    """(key, pos, n, x): number of rows and sum of each entry of ``vector``, by key."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for f in frames:
            if len(f):
                z, keys = stacked(f["v"]), f["key"].to_numpy()
                kinds, inverse = np.unique(keys, return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                at = np.searchsorted(inverse[order], np.arange(len(kinds)))
                for k, s, c in zip(kinds.tolist(), np.add.reduceat(z[order], at), np.bincount(inverse)):
                    total[k] = total.get(k, 0) + s
                    n[k] = n.get(k, 0) + int(c)
        if n:
            yield pd.DataFrame({"key": list(n), "n": list(n.values()), "v": [total[k] for k in n]})

    key = F.col(key) if isinstance(key, str) else key
    d = df.select(key.cast("bigint").alias("key"), doubles(vector).alias("v")).where("v IS NOT NULL AND key IS NOT NULL")
    return _merged(d.mapInPandas(partial, "key bigint, n bigint, v array<double>"))


def class_means(df: DataFrame, vector: Column | str, key: Column | str) -> dict[int, tuple[int, np.ndarray]]:
    """Per key: (number of rows, mean vector)."""
    return {k: (n, x / n) for k, (n, x) in _keyed(vector_sums(df, vector, key)).items()}


def scatter(df: DataFrame, vector: Column | str, centers: dict[str, dict[int, np.ndarray] | np.ndarray], key: str | None = None) -> dict[str, tuple[int, np.ndarray]]:
    """Sums of outer products about given centres, several sets of centres in one pass.

    ``centers`` maps a name to one vector, or to a vector for each value of ``key``. Centring before the products are
    summed keeps their precision when means are large. Returns name -> (rows, D x D matrix).
    """
    names = list(centers)

    def about(name: str, z: np.ndarray, keys: np.ndarray) -> np.ndarray:
        c = centers[name]
        if not isinstance(c, dict):
            return z - c
        kinds, inverse = np.unique(keys, return_inverse=True)
        return z - np.stack([c[int(k)] for k in kinds])[inverse]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, {}
        for f in frames:
            if len(f):
                z = stacked(f["v"])
                n += len(z)
                for name in names:
                    d = about(name, z, f["key"].to_numpy())
                    total[name] = total.get(name, 0) + d.T @ d
        if n:
            yield pd.DataFrame({"key": range(len(names)), "n": [n] * len(names), "v": [total[x].ravel() for x in names]})

    label = F.lit(0) if key is None else F.col(key)
    d = df.select(label.cast("bigint").alias("key"), doubles(vector).alias("v")).where("v IS NOT NULL AND key IS NOT NULL")
    got = _keyed(_merged(d.mapInPandas(partial, "key bigint, n bigint, v array<double>")))
    return {names[k]: (n, x.reshape(int(np.sqrt(len(x))), -1)) for k, (n, x) in got.items()}


def vector_mean(df: DataFrame, vector: Column | str) -> tuple[int, np.ndarray]:
    got = class_means(df, vector, F.lit(0))
    if not got:
        raise ValueError("no rows to fit")
    return got[0]


# ---------------------------------------------------------------- several layers at once


def layer_vectors(df: DataFrame, layers: Sequence[str]) -> list[Column]:
    """One vector a layer: an array of numbers as it is, an array of channels (of positions) as the mean of each channel."""
    out = []
    for layer in layers:
        kind = df.schema[layer].dataType
        nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
        out.append((channel_means(layer) if nested else F.col(layer)).cast("array<double>"))
    return out


def layered_moments(df: DataFrame, layers: Sequence[str], key: str) -> list[tuple[list[int], np.ndarray, int, np.ndarray]]:
    """Per layer (classes, class means, rows, scatter about them): two passes in all, whatever the number of layers.

    A row whose layer is null is left out of that layer. Partials carry the number of the layer in their key.
    """
    many = len(layers)
    names = [f"v{i}" for i in range(many)]
    d = df.select(F.col(key).cast("bigint").alias("key"), *[v.alias(n) for v, n in zip(layer_vectors(df, layers), names)]).where("key IS NOT NULL")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for f in frames:
            for i, name in enumerate(names):
                ok = f[name].notna().to_numpy()
                if ok.any():
                    yield i, f["key"].to_numpy()[ok], stacked(f[name][ok])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for i, keys, z in each(frames):
            for k in np.unique(keys).tolist():
                own = z[keys == k]
                n[k * many + i] = n.get(k * many + i, 0) + len(own)
                total[k * many + i] = total.get(k * many + i, 0) + own.sum(axis=0)
        if n:
            yield pd.DataFrame({"key": list(n), "n": list(n.values()), "v": [total[k] for k in n]})

    schema = "key bigint, n bigint, v array<double>"
    means: list[dict[int, np.ndarray]] = [{} for _ in layers]
    for k, (n, x) in _keyed(_merged(d.mapInPandas(sums, schema))).items():
        means[k % many][k // many] = x / n

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = [0] * many, [None] * many
        for i, keys, z in each(frames):
            kinds, inverse = np.unique(keys, return_inverse=True)
            c = z - np.stack([means[i][int(k)] for k in kinds])[inverse]
            n[i] += len(z)
            total[i] = c.T @ c if total[i] is None else total[i] + c.T @ c
        has = [i for i in range(many) if n[i]]
        if has:
            yield pd.DataFrame({"key": has, "n": [n[i] for i in has], "v": [total[i].ravel() for i in has]})

    scatters = _keyed(_merged(d.mapInPandas(products, schema)))
    out = []
    for i, layer in enumerate(layers):
        if i not in scatters:
            raise ValueError(f"no rows with known labels in {layer}")
        n, x = scatters[i]
        classes = sorted(means[i])
        out.append((classes, np.stack([means[i][k] for k in classes]), n, x.reshape(int(np.sqrt(len(x))), -1)))
    return out
