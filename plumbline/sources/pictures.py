"""Pictures to pixels: a PNG reader on Arrow batches, and the masked street and inspection sets as rows of labelled pixels."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The file's first bytes, samples a pixel by colour type, and the passes of interlaced pictures (x, y, dx, dy).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels beyond which a picture raises, so that a forged header can't fill a task.
MOST_PIXELS = 1 << 28


@dataclass
class Picture:
    """``pixels`` (height x width x channels) as stored: indices where there is a ``palette`` (n x 3)."""

    pixels: np.ndarray
    palette: np.ndarray | None = None

    def colours(self) -> np.ndarray:
        """Height x width x 3 of 8 bits: palettes looked up, grey values repeated, transparency left out, 16 bits cut to 8."""
        p = self.pixels
        if self.palette is not None:
            return self.palette[p[:, :, 0]]
        p = (p >> 8).astype(np.uint8) if p.dtype == np.uint16 else p
        return np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a PNG file ends early")
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0]:
            raise ValueError(f"a PNG file has a damaged part {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("a PNG file has no end")


def unfiltered(kinds: np.ndarray, rows: np.ndarray, unit: int) -> np.ndarray:
    """Undo the row filters: ``rows`` (height x bytes) by ``kinds`` (0 none, 1 left, 2 up, 3 their mean, 4 the nearest of three).

    A byte needs those at its left, above and above left, so all bytes of one anti-diagonal (of units of ``unit`` bytes) are
    worked out together: height + width steps on vectors and no loop over pixels. Rows without the last two filters take the
    sums of a whole row instead.
    """
    height, width = rows.shape
    if (kinds > 4).any():
        raise ValueError("a PNG row has an unknown filter")
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((height + 1, width), np.uint8)
        for y in range(height):
            row = rows[y]
            if kinds[y] == 1:
                row = np.add.accumulate(row.reshape(-1, unit), axis=0, dtype=np.uint8).ravel()
            out[y + 1] = row + out[y] if kinds[y] == 2 else row
        return out[1:]
    columns = width // unit
    # one row and one unit of zeros before the first ones; int16 holds what the predictors need
    out = np.zeros((height + 1, columns + 1, unit), np.int16)
    raw = rows.reshape(height, columns, unit)
    for d in range(height + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(height, d + 1))
        x, kind = d - y, kinds[y][:, None]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.where(kind == 0, 0, np.where(kind == 1, a, np.where(kind == 2, b, np.where(kind == 3, (a + b) >> 1, nearest))))
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width)


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    height = len(rows)
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").astype(np.uint16).reshape(height, width, channels)
    if depth == 8:
        return rows.reshape(height, width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, :, None]


def read_png(content: bytes) -> Picture:
    """Decode a PNG file: all colour types, depths of 1 to 16 bits, all filters, interlacing. Damaged files raise ValueError."""
    content = bytes(content)
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    head, palette, packed = None, None, []
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("a PNG file has no header")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour not in (0, 3)) or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("a PNG file has a header that isn't valid")
    channels = CHANNELS[colour]
    passes = [(x, y, dx, dy) for x, y, dx, dy in (ADAM7 if interlaced else ((0, 0, 1, 1),)) if x < width and y < height]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in passes]
    sizes = [h * (1 + (w * channels * depth + 7) // 8) for h, w in shapes]
    inflate = zlib.decompressobj()
    data = inflate.decompress(b"".join(packed), sum(sizes) + 1)
    if len(data) < sum(sizes):
        raise ValueError("a PNG file has too few bytes of pixels")
    out, at = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, dx, dy), (h, w), size in zip(passes, shapes, sizes):
        rows = np.frombuffer(data, np.uint8, size, at).reshape(h, -1)
        at += size
        flat = unfiltered(rows[:, 0].astype(np.int64), rows[:, 1:], max(1, channels * depth // 8))
        out[y::dy, x::dx] = _samples(flat, w, channels, depth)
    return Picture(out, palette if colour == 3 else None)


# ---------------------------------------------------------------- rows of pixels

#: A row of a picture: its number, the values of all pixels (channel by channel of each) and the label of each.
ROW = "y int, width int, channels int, pixels array<int>, labels array<int>"
Decoder = Callable[[dict], tuple[np.ndarray, np.ndarray | None]]


def picture_rows(df: DataFrame, decode: Decoder, *, inputs: tuple[str, ...] = ("content", "mask"), image: str = "path") -> DataFrame:
    """(image_id, y, width, channels, pixels, labels): one row for each row of a picture.

    ``decode`` turns the files of a row of ``df``, by column name, into pixels (height x width x channels) and labels (height x
    width) or None. Pictures come out one at a time, in slices of rows, so a task holds one decoded picture, beside the files of
    one Arrow batch (``spark.sql.execution.arrow.maxBytesPerBatch``). A null file is None; a null first file gives no rows.
    """
    columns = list(inputs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                if row[columns[0]] is None:
                    continue
                pixels, labels = decode({c: row[c] for c in columns})
                height, width = pixels.shape[:2]
                flat = pixels.reshape(height, -1).astype(np.int32)
                step = max(1, (1 << 20) // max(1, flat.shape[1]))
                for y in range(0, height, step):
                    part = flat[y : y + step]
                    marks = [None] * len(part) if labels is None else list(labels[y : y + step].astype(np.int32))
                    yield pd.DataFrame({"image_id": row["image_id"], "y": np.arange(y, y + len(part), dtype=np.int32), "width": width, "channels": pixels.shape[2], "pixels": list(part), "labels": marks})

    d = df.select(F.col(image).cast("string").alias("image_id"), *columns)
    return d.mapInPandas(work, "image_id string, " + ROW)


def pixel_labels(rows: DataFrame) -> DataFrame:
    """(image_id, px, label) of every labelled pixel of :func:`picture_rows`; px counts along the rows from 0."""
    d = rows.where("labels IS NOT NULL").select("image_id", "y", "width", F.posexplode("labels").alias("x", "label"))
    return d.select("image_id", (F.col("y").cast("bigint") * F.col("width") + F.col("x")).alias("px"), "label")


def pixel_vectors(rows: DataFrame) -> DataFrame:
    """(image_id, px, features, label): the channels of each pixel as an array, for detectors that score pixels."""
    step = F.sequence(F.lit(0), F.col("width") - 1)
    each = F.transform(step, lambda x: F.slice("pixels", x * F.col("channels") + 1, F.col("channels")).cast("array<double>"))
    zipped = F.arrays_zip(each.alias("features"), F.coalesce("labels", F.array_repeat(F.lit(None).cast("int"), F.col("width"))).alias("label"))
    d = rows.select("image_id", "y", "width", F.posexplode(zipped).alias("x", "p"))
    return d.select("image_id", (F.col("y").cast("bigint") * F.col("width") + F.col("x")).alias("px"), "p.features", "p.label")


def plain_picture(files: dict) -> tuple[np.ndarray, None]:
    return read_png(files["content"]).colours(), None


def _grey(content: bytes) -> np.ndarray:
    """The first channel as stored, which holds the values of a mask (or a palette's indices)."""
    return read_png(content).pixels[:, :, 0].astype(np.int64)


def overlaid(files: dict, void_label: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A street image plus its overlay, cut to 0..255; -1 where the overlay is not zero, else ``void_label`` where void, else 0."""
    overlay = np.load(io.BytesIO(files["content"]), allow_pickle=False)["rgb"].astype(np.int64)
    street = read_png(files["original"]).colours().astype(np.int64)
    void = _grey(files["mask"]) != 0
    return np.clip(street + overlay, 0, 255), np.where((overlay != 0).any(axis=2), -1, np.where(void, void_label, 0))


def lost_objects(files: dict) -> tuple[np.ndarray, np.ndarray]:
    mask = _grey(files["mask"])
    return read_png(files["content"]).colours(), np.where(mask == 1, -1, np.where(mask == 255, 1, 0))


def hazards(files: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes count from 0; those from the fourteenth on are outliers."""
    classes = _grey(files["mask"]) - 1
    return read_png(files["content"]).colours(), np.where(classes >= 13, -1, classes)


def defects(files: dict) -> tuple[np.ndarray, np.ndarray]:
    """Any positive mask value is an outlier; without a mask the whole picture is normal."""
    pixels = read_png(files["content"]).colours()
    return pixels, np.zeros(pixels.shape[:2], int) if files["mask"] is None else np.where(_grey(files["mask"]) > 0, -1, 0)


def fishyscapes_rows(files: DataFrame) -> DataFrame:
    """:func:`picture_rows` of what ``files.fishyscapes`` pairs."""
    return picture_rows(files, overlaid, inputs=("content", "mask", "original"))


def lost_and_found_rows(files: DataFrame) -> DataFrame:
    return picture_rows(files, lost_objects)


def street_hazards_rows(files: DataFrame) -> DataFrame:
    return picture_rows(files, hazards)


def inspection_rows(files: DataFrame) -> DataFrame:
    return picture_rows(files, defects)
