"""Objects from annotations: masks of polygons and run lengths, cut-outs, and their insertion into pictures by keyed joins."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import vectors as V
from ..operators.metrics import running_totals
from .augment import Annotations
from .pictures import read_png

#: The compressed run-length form writes 5 bits a character from this code on; bit 6 says that more follow.
FIRST_CODE = 48
PICTURE = "height int, width int, pixels array<int>"


def run_lengths(text: str) -> list[int]:
    """Run lengths of the compressed text form: little-endian groups of 5 bits, signed; from the fourth on as differences to the
    one two places before."""
    out: list[int] = []
    value = shift = 0
    for ch in text:
        code = ord(ch) - FIRST_CODE
        if not 0 <= code < 64:
            raise ValueError(f"{ch!r} isn't a run-length character")
        value |= (code & 31) << shift
        shift += 5
        if not code & 32:
            if code & 16:
                value -= 1 << shift
            out.append(value + out[-2] if len(out) > 2 else value)
            value = shift = 0
    if shift:
        raise ValueError("run lengths end inside of a number")
    return out


def runs_filled(counts: Sequence[int], height: int, width: int) -> np.ndarray:
    """Mask of run lengths, background first, column by column."""
    if sum(counts) != height * width or min(counts, default=0) < 0:
        raise ValueError("run lengths don't fill the mask")
    return np.repeat(np.arange(len(counts)) % 2, counts).astype(bool).reshape(width, height).T


def ring_filled(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scanline fill of a ring: pixels whose centre is inside by the even-odd rule.

    Each edge marks, in the rows that it crosses, the first pixel at its right; the parity of the marks so far fills the row.
    """
    marks = np.zeros((height, width + 1), np.uint8)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0)):
        low, high = sorted((y0, y1))
        rows = np.arange(max(0, int(np.ceil(low - 0.5))), min(height, int(np.ceil(high - 0.5))))
        if len(rows):
            x = (x1 - x0) * (rows + 0.5 - y0) / (y1 - y0) + x0
            np.bitwise_xor.at(marks, (rows, np.clip(np.ceil(x - 0.5), 0, width).astype(int)), 1)
    return np.bitwise_xor.accumulate(marks, axis=1)[:, :width].astype(bool)


def rings_filled(rings: Sequence[Sequence[float]], height: int, width: int) -> np.ndarray:
    """Mask of several rings (x, y, x, y, ...): one that lies inside of what larger ones fill is a hole in it, others are added."""
    masks = []
    for ring in rings:
        if len(ring) % 2:
            raise ValueError("a polygon has an odd number of coordinates")
        masks.append(ring_filled(np.asarray(ring, np.float64).reshape(-1, 2), height, width))
    out = np.zeros((height, width), bool)
    for m in sorted(masks, key=lambda m: -int(m.sum())):
        out = out | m if (m & ~out).any() else out & ~m
    return out


def segment_mask(segmentation: str, height: int, width: int) -> np.ndarray:
    """Mask of an annotation's segmentation as JSON: polygons, run lengths, or the compressed text form of these."""
    got = json.loads(segmentation)
    if isinstance(got, list):
        return rings_filled(got, height, width)
    if list(got.get("size", [])) != [height, width]:
        raise ValueError("run lengths are of another size than the image")
    counts = got["counts"]
    return runs_filled(run_lengths(counts) if isinstance(counts, str) else counts, height, width)


def png_pictures(files: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(keys, height, width, pixels): PNG files decoded, channel by channel, a picture an Arrow batch."""
    d = files.select(*keys, F.col(content).alias("_content")).where("_content IS NOT NULL")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(len(f)):
                p = read_png(f["_content"].iloc[k]).colours()
                yield f.drop(columns="_content").iloc[k : k + 1].assign(height=p.shape[0], width=p.shape[1], pixels=[p.transpose(2, 0, 1).ravel().astype(np.int32)])

    return d.mapInPandas(work, (own + ", " if own else "") + PICTURE)


def cut_outs(annotations: Annotations, pictures: DataFrame, ids: DataFrame | None = None, *, most: int = 1) -> DataFrame:
    """(image_id, height, width, pixels, mask) of the objects in annotated pictures, cut to the box around them.

    ``pictures`` has image_id, height, width and pixels. Up to ``most`` annotations of a picture, those of the smallest ids, make its
    cut-out together; ``ids`` restricts the annotations. Pictures without any pixel of an object give none.
    """
    a = annotations.annotations if ids is None else annotations.load("annotations", ids)
    segments = F.col("segmentation") if isinstance(a.schema["segmentation"].dataType, StringType) else F.to_json("segmentation")
    listed = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("id", segments.alias("s")))), 1, most), lambda e: e["s"])
    per = a.where(F.col("segmentation").isNotNull()).groupBy("image_id").agg(listed.alias("segments"))
    d = pictures.select("image_id", "height", "width", "pixels").join(per, "image_id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                mask = np.zeros((r.height, r.width), bool)
                for s in r.segments:
                    mask |= segment_mask(s, r.height, r.width)
                if mask.any():
                    y, x = (np.flatnonzero(mask.any(axis=k)) for k in (1, 0))
                    box = (slice(y[0], y[-1] + 1), slice(x[0], x[-1] + 1))
                    p = np.asarray(r.pixels).reshape(3, r.height, r.width)[:, box[0], box[1]]
                    yield pd.DataFrame({"image_id": [r.image_id], "height": p.shape[1], "width": p.shape[2], "pixels": [p.ravel().astype(np.int32)], "mask": [mask[box].astype(np.int32).ravel()]})

    kind = pictures.schema["image_id"].dataType.simpleString()
    return d.mapInPandas(work, f"image_id {kind}, {PICTURE}, mask array<int>")


def turned(picture: np.ndarray, cut: np.ndarray, height: int, width: int, angle: float, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """A cut-out (3 x h x w, h x w) resized to ``height`` x ``width``, turned about its middle and flipped, by nearest pixels."""
    y, x = np.mgrid[:height, :width] + 0.5
    if flip:
        x = width - x
    y, x = y - height / 2, x - width / 2
    a, b = np.cos(angle), np.sin(angle)
    v, u = a * y + b * x + height / 2, a * x - b * y + width / 2
    inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
    at = (np.clip(v * cut.shape[0] / height, 0, cut.shape[0] - 1).astype(int), np.clip(u * cut.shape[1] / width, 0, cut.shape[1] - 1).astype(int))
    return picture[:, at[0], at[1]], (cut[at] > 0) & inside


def insert_objects(df: DataFrame, objects: DataFrame, *, row_id: str = "id", probability: float = 0.2, n: int = 1, scale: tuple[float, float] = (0.28, 0.70), label: int = -1, seed: int = 0) -> DataFrame:
    """Insert ``n`` objects into a share of the pictures and set their pixels in ``mask`` to ``label``.

    ``df`` has ``row_id``, height, width, pixels (channel by channel) and mask; ``objects`` comes from :func:`cut_outs`, of any
    size. Objects are numbered in a hashed order, each picture draws numbers by its id, and a join brings what it drew: nothing is
    gathered. Size, turn, flip and place follow from the picture's id, so they are the same on every partitioning. Each inserted
    object is marked. Without objects pictures stay as they are.
    """
    numbered = running_totals(objects.select("height", "width", "pixels", "mask", F.xxhash64("image_id", "height", "pixels").cast("double").alias("order"), F.lit(1).cast("bigint").alias("one")), "order", ["one"], descending=False)
    numbered = numbered.select((F.col("cum_one") - 1).alias("number"), F.struct("height", "width", "pixels", "mask").alias("object"), F.col("all_one").alias("all"))
    many = objects.count()
    key = F.col(f"`{row_id}`").cast("bigint")
    drawn = df.select(key.alias("key")).where(V.unit_hash(F.col("key"), "insert", seed) <= F.lit(float(probability))).distinct()
    slots = drawn.select("key", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"))
    number = F.floor(V.unit_hash(F.col("key"), F.col("slot"), seed) * F.lit(float(many))).cast("bigint")
    got = slots.withColumn("number", number).join(numbered, "number").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "number", "object"))).alias("objects"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key")).join(got, "key", "left")
    flat = rows.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], F.col("objects").alias("_objects"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pixels, masks = [], []
            for who, h, w, p, m, found in zip(f[row_id], f["height"], f["width"], f["pixels"], f["mask"], f["_objects"]):
                p, m = np.array(p).reshape(3, h, w), np.array(m).reshape(h, w)
                rng = np.random.default_rng([seed, int(who) & (2**63 - 1)])
                for e in found if found is not None else ():
                    o = e["object"]
                    size = rng.uniform(*scale)
                    a, b = max(1, int(h * size)), max(1, int(w * size))
                    picture, cut = turned(np.asarray(o["pixels"]).reshape(3, o["height"], o["width"]), np.asarray(o["mask"]).reshape(o["height"], o["width"]), a, b, rng.uniform(0, 2 * np.pi), rng.random() < 0.5)
                    y, x = rng.integers(h - a + 1), rng.integers(w - b + 1)
                    p[:, y : y + a, x : x + b] = np.where(cut, picture, p[:, y : y + a, x : x + b])
                    m[y : y + a, x : x + b] = np.where(cut, label, m[y : y + a, x : x + b])
                pixels.append(p.ravel())
                masks.append(m.ravel())
            yield f.drop(columns="_objects").assign(pixels=pixels, mask=masks)

    return flat.mapInPandas(work, df.schema)


def insert_annotated(df: DataFrame, annotations: Annotations, pictures: DataFrame, *, without: Sequence[int] = (), min_width: int = 0, min_height: int = 0, most: int = 1, **how) -> DataFrame:
    """From annotations to pictures with objects in one call: annotated ``pictures`` that show none of the categories ``without`` and
    are large enough give the cut-outs, which :func:`insert_objects` puts into ``df``."""
    usable = annotations.images_without(list(without), min_width=min_width, min_height=min_height).select(F.col("id").alias("image_id"))
    return insert_objects(df, cut_outs(annotations, pictures.join(usable, "image_id", "left_semi"), most=most), **how)
