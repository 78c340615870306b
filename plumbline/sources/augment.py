"""Annotation graphs, run-length masks, pasted objects and picture mixing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


class Annotations:
    """An object-annotation file as three tables: images, annotations and categories."""

    def __init__(self, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
        self.images, self.annotations, self.categories = images, annotations, categories

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Annotations:
        d = spark.read.option("multiLine", "true").json(path)
        tables = [d.select(F.explode(name).alias("r")).select("r.*") for name in ("images", "annotations", "categories")]
        return cls(*tables)

    def annotation_ids(self, *, images: Sequence[int] = (), categories: Sequence[int] = (), area: tuple[float, float] | None = None, crowd: int | None = None) -> DataFrame:
        """Ids of annotations by image, category, area range (exclusive) and crowd flag; without images there are none."""
        a = self.annotations.where(F.col("image_id").isin(list(images)) if images else F.lit(False))
        if categories:
            a = a.where(F.col("category_id").isin(list(categories)))
        if area is not None:
            a = a.where((F.col("area") > area[0]) & (F.col("area") < area[1]))
        if crowd is not None:
            a = a.where(F.col("iscrowd") == crowd)
        return a.select("id")

    def category_ids(self, *, names: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
        c = self.categories
        if names:
            c = c.where(F.col("name").isin(list(names)))
        if groups:
            c = c.where(F.col("supercategory").isin(list(groups)))
        return c.select("id")

    def image_ids(self, *, categories: Sequence[int] = ()) -> DataFrame:
        """Images that show every one of the categories (all images without any)."""
        if not categories:
            return self.images.select("id")
        wanted = sorted(set(categories))
        a = self.annotations.where(F.col("category_id").isin(wanted)).select("image_id", "category_id").distinct()
        return a.groupBy("image_id").count().where(F.col("count") == len(wanted)).select(F.col("image_id").alias("id"))

    def load(self, kind: str, ids: DataFrame) -> DataFrame:
        return getattr(self, kind).join(ids.select("id").distinct(), "id", "left_semi")

    def images_without(self, categories: Sequence[int], *, min_width: int = 0, min_height: int = 0) -> DataFrame:
        bad = self.annotations.where(F.col("category_id").isin(list(categories))).select(F.col("image_id").alias("id")).distinct()
        return self.images.where((F.col("width") >= min_width) & (F.col("height") >= min_height)).join(bad, "id", "left_anti")


def run_length_mask(counts: Column, height: Column | int, width: Column | int) -> Column:
    """Run lengths (background first, column by column) to a row-major 0/1 array; wrong totals raise."""
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    flat = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(F.pmod(i, F.lit(2)).cast("int"), n.cast("int"))))
    by_row = F.transform(F.sequence(F.lit(0), h * w - 1), lambda k: F.get(flat, (F.pmod(k, w) * h + F.floor(k / w)).cast("int")))
    bad = F.raise_error(F.lit("run lengths don't fill the mask")).cast("array<int>")
    return F.when(F.size(flat) == h * w, by_row).otherwise(bad)


def polygon_mask(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """0/1 mask of the pixels whose centre lies inside the polygon (even-odd rule)."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0)):
        if y0 != y1:
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside.astype(np.uint8)


#: Numbers of a bank of pictures that goes to every task with the function that uses it; larger ones raise.
BANK_NUMBERS = 16_000_000


def _bank(df: DataFrame, *columns: str) -> list[tuple[np.ndarray, ...]]:
    """The rows of a small table of arrays, in an order of their own values; raises if it has more than BANK_NUMBERS."""
    numbers = sum((F.coalesce(F.size(c), F.lit(0)) for c in columns), F.lit(0))
    if (df.agg(F.sum(numbers.cast("bigint")).alias("n")).first().n or 0) > BANK_NUMBERS:
        raise ValueError(f"a bank of pictures has more than {BANK_NUMBERS} numbers")
    rows = df.select(*columns).orderBy(F.xxhash64(*columns)).collect()
    return [tuple(np.asarray(r[c]) for c in columns) for r in rows]


def paste_objects(df: DataFrame, objects: DataFrame, *, object_size: tuple[int, int], row_id: str = "id", probability: float = 0.2, n: int = 1, seed: int = 0) -> DataFrame:
    """Paste ``n`` cut-outs into a share of the images and mark their pixels -1.

    ``df`` has height, width, pixels (array of 3*h*w, channel by channel) and mask (array of h*w). ``objects`` is a small
    table (its size is checked) of cut-outs of ``object_size`` (rows, columns), with the columns pixels and mask alike.
    Position, scale (0.28 to 0.70 of the image) and flip come from the row's id. Every pasted object is marked, not only
    the last.
    """
    cut_outs = [(p.reshape(3, *object_size), m.reshape(object_size)) for p, m in _bank(objects, "pixels", "mask")]
    shared = df.sparkSession.sparkContext.broadcast(cut_outs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = shared.value
        for f in frames:
            pixels, masks = [], []
            for key, h, w, p, m in zip(f[row_id], f["height"], f["width"], f["pixels"], f["mask"]):
                rng = np.random.default_rng([seed, int(key)])
                p, m = np.array(p).reshape(3, h, w), np.array(m).reshape(h, w)
                if bank and rng.random() <= probability:
                    for _ in range(n):
                        picture, cut = bank[rng.integers(len(bank))]
                        if rng.random() < 0.5:
                            picture, cut = picture[:, :, ::-1], cut[:, ::-1]
                        scale = rng.uniform(0.28, 0.70)
                        a, b = max(1, int(h * scale)), max(1, int(w * scale))
                        rows, cols = np.arange(a) * cut.shape[0] // a, np.arange(b) * cut.shape[1] // b
                        small, shape = picture[:, rows][:, :, cols], cut[rows][:, cols] > 0
                        y, x = rng.integers(h - a + 1), rng.integers(w - b + 1)
                        p[:, y : y + a, x : x + b] = np.where(shape, small, p[:, y : y + a, x : x + b])
                        m[y : y + a, x : x + b] = np.where(shape, -1, m[y : y + a, x : x + b])
                pixels.append(p.ravel())
                masks.append(m.ravel())
            yield f.assign(pixels=pixels, mask=masks)

    return df.mapInPandas(work, df.schema)


# ---------------------------------------------------------------- picture mixing
#
# Mixing follows the paper's two formulas for pictures p and q with values from 0 to 1 and coefficients s and t: the sum
# s p' + t q' of both on a scale from -1 to 1, and the product p''^s q''^t of both on a scale from 0 to 2.

#: Smallest value of a picture that is raised to a power, which may be negative.
FLOOR = np.finfo(np.float32).tiny


def additive(p: np.ndarray, q: np.ndarray, s: float, t: float) -> np.ndarray:
    return 0.5 + s * (p - 0.5) + t * (q - 0.5)


def multiplicative(p: np.ndarray, q: np.ndarray, s: float, t: float) -> np.ndarray:
    """Half of p''^s q''^t, by logarithms."""
    return np.exp(s * np.log(np.maximum(2 * p, FLOOR)) + t * np.log(np.maximum(2 * q, FLOOR))) / 2


def coefficients(rng: np.random.Generator, beta: float) -> tuple[float, float]:
    """The paper's draws: half of the time s from Beta(beta, 1) and t from Beta(1, beta), else s from 1 + Beta(1, beta) and t from -Beta(1, beta)."""
    if rng.random() < 0.5:
        return rng.beta(beta, 1), rng.beta(1, beta)
    return 1 + rng.beta(1, beta), -rng.beta(1, beta)


def equalised(x: np.ndarray) -> np.ndarray:
    """Bytes whose cumulative histogram is as even as their ties allow."""
    counts = np.bincount(x.ravel(), minlength=256)
    used = counts[counts > 0]
    step = (used.sum() - used[-1]) // 255
    if not step:
        return x
    return np.minimum((step // 2 + np.cumsum(counts) - counts) // step, 255)[x]


def stretched(x: np.ndarray) -> np.ndarray:
    """Bytes stretched so that the least is 0 and the largest 255."""
    low, high = int(x.min()), int(x.max())
    return x if high <= low else ((x - low) * 255 / (high - low)).astype(np.int64)


def turned(x: np.ndarray, degrees: float) -> np.ndarray:
    """Channels turned about their centre, nearest pixel, what comes in from outside is 0."""
    h, w = x.shape[1:]
    angle = np.deg2rad(degrees)
    dy, dx = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    row = np.rint((h - 1) / 2 + np.cos(angle) * dy + np.sin(angle) * dx).astype(int)
    col = np.rint((w - 1) / 2 - np.sin(angle) * dy + np.cos(angle) * dx).astype(int)
    inside = (row >= 0) & (row < h) & (col >= 0) & (col < w)
    return np.where(inside, x[:, row.clip(0, h - 1), col.clip(0, w - 1)], 0)


AUGMENTATIONS = ("equalise", "stretch", "posterise", "turn", "solarise")


def augmented(x: np.ndarray, kind: str, severity: int) -> np.ndarray:
    """One augmentation of a picture (channels first, values 0 to 1), in bytes. Severity is what the published form makes of
    it: bits that stay (posterise), degrees (turn), the value from which bytes are inverted (solarise)."""
    b = np.rint(np.clip(x, 0, 1) * 255).astype(np.int64)
    if kind == "equalise":
        b = np.stack([equalised(c) for c in b])
    elif kind == "stretch":
        b = np.stack([stretched(c) for c in b])
    elif kind == "posterise":
        b = b & (256 - (1 << (8 - severity)))
    elif kind == "turn":
        b = turned(b, severity)
    elif kind == "solarise":
        b = np.where(b >= severity, 255 - b, b)
    else:
        raise ValueError(f"augmentation must be one of {AUGMENTATIONS}")
    return b / 255


def pixmix(df: DataFrame, mixing: DataFrame, *, shape: tuple[int, int, int], row_id: str = "id", k: int = 4, beta: float = 3.0, severity: int = 3, mean: Sequence[float] | None = None, std: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """Mix each picture (``pixels``, values 0 to 1) up to ``k`` times with its picture of ``mixing`` or a copy of itself.

    ``mixing`` is a small table with a column ``pixels``; its size is checked. The picture, and each copy, is augmented
    half of the time. With ``mean`` and ``std`` the result is normalised by channel. All choices of a row come from its
    id, so the result is the same on every partitioning.
    """
    pictures = [p.reshape(shape) for (p,) in _bank(mixing, "pixels")]
    if not pictures:
        raise ValueError("no pictures to mix with")
    middle = np.zeros(shape[0]) if mean is None else np.asarray(mean, np.float64)
    spread = np.ones(shape[0]) if std is None else np.asarray(std, np.float64)
    shared = df.sparkSession.sparkContext.broadcast(pictures)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = shared.value
        for f in frames:
            out = []
            for key, p in zip(f[row_id], f["pixels"]):
                rng = np.random.default_rng([seed, int(key)])
                x = np.asarray(p, np.float64).reshape(shape)
                partner = bank[rng.integers(len(bank))]
                either = lambda other, x=x, rng=rng: augmented(x, rng.choice(AUGMENTATIONS), severity) if rng.random() < 0.5 else other
                mixed = either(x)
                for _ in range(rng.integers(k + 1)):
                    other = either(partner)
                    blend = additive if rng.random() < 0.5 else multiplicative
                    mixed = np.clip(blend(mixed, other, *coefficients(rng, beta)), 0, 1)
                out.append(((mixed - middle[:, None, None]) / spread[:, None, None]).ravel())
            yield f.assign(pixels=out)

    return df.mapInPandas(work, df.schema)


def to_rgb(pixels: Column, channels: Column | int) -> Column:
    """One-channel pictures are repeated to three channels; alpha is dropped; pixels are channel by channel."""
    c = channels if isinstance(channels, Column) else F.lit(channels)
    third = F.slice(pixels, 1, (F.size(pixels) / c * 3).cast("int"))
    return F.when(c == 1, F.concat(pixels, pixels, pixels)).when(c >= 3, third)


NORMALISE = V.normalised
