"""File-tree and array sources: images, audio, arrays and generated noise as tables (path, content, label)."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.labels import dense_labels
from .arrays import array_rows
from .fixed_values import CIFAR_C, FSDD_SPEAKERS, IMAGENET_C, MNIST_C


def base_name(path: Column | str = "path") -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def parent_name(path: Column | str = "path", up: int = 1) -> Column:
    return F.try_element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), F.lit(-1 - up))


def file_tree(spark: SparkSession, root: str, pattern: str = "*", *, label: int = -1) -> DataFrame:
    """All files below ``root`` whose name fits ``pattern``: path, content, label. Hidden files are left out.

    Content is read only if a later step uses it.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return d.where(~base_name().startswith(".")).select("path", "content", F.lit(label).alias("label"))


def class_tree(spark: SparkSession, root: str, pattern: str = "*", *, densify: bool = True) -> DataFrame:
    """Files of a class-folder tree; the label numbers the folders in ascending order."""
    d = file_tree(spark, root, pattern).drop("label").withColumn("class_name", parent_name())
    return dense_labels(d, "class_name") if densify else d


#: Outlier folders of images: file pattern of each; every row is labelled -1.
OUTLIER_FOLDERS = {
    "Textures": "*.jpg",
    "FoolingImages": "*.png",
    "NINCO": "*",
    "TinyImageNetCrop": "*",
    "TinyImageNetResize": "*",
    "LSUNCrop": "*",
    "LSUNResize": "*",
    "iNaturalist": "*.jpg",
    "Places365": "*.jpg",
    "FeatureVis": "*",
    "Fractals": "*",
}


def outlier_folder(spark: SparkSession, name: str, root: str) -> DataFrame:
    return file_tree(spark, root, OUTLIER_FOLDERS[name])


def imagenet_variant(spark: SparkSession, root: str) -> DataFrame:
    """Class folders with jpg or JPEG files (the A, O and R variants)."""
    return class_tree(spark, root, "*.{jpg,JPEG}")


def imagenet_c(spark: SparkSession, root: str, subset: str) -> DataFrame:
    if subset not in IMAGENET_C:
        raise ValueError(f"subset must be one of {IMAGENET_C}")
    return file_tree(spark, f"{root}/{subset}", "*.JPEG")


def tiny_imagenet(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """train: class folders; val: an annotation table joined by file name; test: label -1."""
    if split == "train":
        d = file_tree(spark, f"{root}/train", "*.JPEG").drop("label").withColumn("class_name", parent_name(up=2))
        return dense_labels(d, "class_name")
    if split == "test":
        return file_tree(spark, f"{root}/test", "*.JPEG")
    if split != "val":
        raise ValueError("split must be train, val or test")
    parts = F.split("value", r"\s+")
    notes = spark.read.text(f"{root}/val/val_annotations.txt").select(parts[0].alias("_file"), parts[1].alias("class_name"))
    d = file_tree(spark, f"{root}/val", "*.JPEG").drop("label").withColumn("_file", base_name())
    return dense_labels(d.join(notes, "_file").drop("_file"), "class_name")


def including(df: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Only files whose name is on the list (a semi-join; lists of any size)."""
    listed = names.select(F.col(name).alias("listed"))
    return df.join(listed, base_name(df["path"]) == listed["listed"], "left_semi")


def excluding(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Only rows whose key is not on the list (an anti-join)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def open_images_o(spark: SparkSession, root: str, inclusion: str) -> DataFrame:
    """Images that the JSON list of file names includes."""
    names = spark.read.option("wholetext", "true").text(inclusion).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return including(file_tree(spark, root), names.select(base_name("name").alias("name")))


def chars74k(spark: SparkSession, root: str) -> DataFrame:
    """Label from the folder ``SampleNNN`` (NNN - 1), densified."""
    d = file_tree(spark, root, "*.png").drop("label")
    raw = F.regexp_extract(parent_name(), r"Sample(\d+)", 1).try_cast("int") - 1
    return dense_labels(d.withColumn("sample", raw).where("sample IS NOT NULL"), "sample")


def spoken_digits(spark: SparkSession, root: str) -> DataFrame:
    """Recordings named ``digit_speaker_take.wav``, with what is known about the speaker."""
    parts = F.split(base_name(), "_")
    who = F.create_map(*[x for k, v in FSDD_SPEAKERS.items() for x in (F.lit(k), F.struct(*[F.lit(w).alias(n) for n, w in zip(("gender", "accent", "language"), v)]))])
    d = file_tree(spark, root, "*.wav").drop("label")
    return d.select("path", "content", parts[0].try_cast("int").alias("label"), parts[1].alias("speaker")).withColumn("about", F.try_element_at(who, F.col("speaker")))


# ---------------------------------------------------------------- arrays and records


def npy_rows(files: DataFrame, member: str | None = None) -> DataFrame:
    """(path, pos, values): one row for each first-axis entry of the .npy files (or of a member of .npz archives).

    For small files in stores that only Spark opens: a file is one binary row of one task. Others are read by ranges, see
    :func:`arrays.array_rows`.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a if member is None else a[member]
                for at in range(0, len(a), 1024):
                    some = a[at : at + 1024].reshape(len(a[at : at + 1024]), -1).astype(np.float64)
                    yield pd.DataFrame({"path": path, "pos": np.arange(at, at + len(some)), "values": list(some)})

    return files.select("path", "content").mapInPandas(parse, "path string, pos bigint, values array<double>")


def corrupted_arrays(spark: SparkSession, root: str, subset: str = "all", *, subsets: Sequence[str] = CIFAR_C) -> DataFrame:
    """One .npy a corruption plus ``labels.npy``: (subset, pos, values, label); "all" reads every corruption."""
    if subset != "all" and subset not in subsets:
        raise ValueError(f"subset must be all or one of {tuple(subsets)}")
    names = list(subsets) if subset == "all" else [subset]
    rows = array_rows(spark, [f"{root}/{n}.npy" for n in names]).select(F.regexp_replace(base_name(), r"\.npy$", "").alias("subset"), "pos", "values")
    return rows.join(_array_labels(spark, f"{root}/labels.npy"), "pos")


def _array_labels(spark: SparkSession, path: str) -> DataFrame:
    return array_rows(spark, path, schema="pos bigint, values array<int>").select("pos", F.col("values")[0].alias("label"))


def mnist_c(spark: SparkSession, root: str, subset: str, split: str = "test") -> DataFrame:
    if subset not in MNIST_C:
        raise ValueError(f"subset must be one of {MNIST_C}")
    file = lambda kind: f"{root}/{subset}/{split}_{kind}.npy"
    rows = array_rows(spark, file("images"), schema="pos bigint, values array<double>")
    return rows.join(_array_labels(spark, file("labels")), "pos").withColumn("subset", F.lit(subset))


def cifar_records(spark: SparkSession, root: str, train: bool = True, *, classes: int = 10) -> DataFrame:
    """(path, pos, content, label): pictures of 3 x 32 x 32 bytes in the binary form of the two sets (10 or 100 classes).

    A record is its labels (one byte, or a coarse and a fine one) and the picture.
    """
    if classes not in (10, 100):
        raise ValueError("classes must be 10 or 100")
    names = "{data_batch_*,train}.bin" if train else "{test_batch,test}.bin"
    return _records(spark, root, names, 0, (1 if classes == 10 else 2) + 3072, 3072)


def idx_images(spark: SparkSession, root: str, train: bool = True) -> DataFrame:
    """(path, pos, content, label): the idx files of 28 x 28 pictures and of their labels, paired by position."""
    part = "train" if train else "t10k"
    images = _records(spark, root, f"{part}-images*", 16, 784, 784).drop("label")
    labels = _records(spark, root, f"{part}-labels*", 8, 1, 0)
    return images.join(labels.select("pos", "label"), "pos").select("path", "pos", "content", "label")


def _records(spark: SparkSession, root: str, pattern: str, header: int, size: int, picture: int) -> DataFrame:
    """Records of ``size`` bytes after a header: the last ``picture`` bytes are content, the byte before them the label."""

    raw = F.col("values")
    label = F.expr(f"CAST(conv(hex(substring(values, {size - picture}, 1)), 16, 10) AS INT)") if size > picture else F.lit(-1)
    d = array_rows(spark, root, kind="records", pattern=pattern, header=header, record=size, schema="path string, pos bigint, values binary")
    return d.select("path", "pos", F.substring(raw, size - picture + 1, picture).alias("content"), label.alias("label"))


def fixed_records(spark: SparkSession, path: str, size: int = 3072) -> DataFrame:
    """(pos, content): files of fixed-size records, split at record borders; the position is the record's number in its file."""
    return array_rows(spark, path, kind="records", record=size, schema="pos bigint, values binary").withColumnRenamed("values", "content")


def tiny_images(spark: SparkSession, path: str, *, excluded: str | None = None, draws: int | None = None, seed: int = 0, size: int = 3072, **options) -> DataFrame:
    """(pos, content, label -1): pictures of 3 x 32 x 32 bytes in one file of records.

    ``excluded`` names a file of record numbers (from 1, a line each) that are in a known set. With it, or with ``draws``, that many
    records (default: all others) come in a shuffled order of ``seed``: none excluded, none twice, the same on any partitioning.
    """
    draws = -1 if draws is None and excluded else draws
    d = array_rows(spark, path, kind="records", record=size, schema="pos bigint, values binary", draws=draws, excluded=excluded, seed=seed, **options)
    return d.select("pos", F.col("values").alias("content"), F.lit(-1).alias("label"))


def outlier_array(spark: SparkSession, path: str) -> DataFrame:
    """(pos, values, label -1): the pictures of one .npy file, such as the 300,000 cleaned ones or generated ones."""
    return array_rows(spark, path, schema="pos bigint, values array<double>").withColumn("label", F.lit(-1))


# ---------------------------------------------------------------- masks and derived keys


def fishyscapes_original(path: Column) -> Column:
    """``0000_city_000001_046504_rgb.npz`` to ``city/city_000001_046504_leftImg8bit.png``."""
    parts = F.split(path, "_")
    rest = F.array_join(F.slice(parts, 2, F.size(parts) - 1), "_")
    return F.concat(parts[1], F.lit("/"), F.regexp_replace(rest, r"rgb\.npz$", "leftImg8bit.png"))


def lost_and_found_original(path: Column) -> Column:
    """``0000_place_a_b_labels.png`` to ``place/place_a_b_leftImg8bit.png``."""
    parts = F.split(path, "_")
    folder = F.array_join(F.slice(parts, 2, F.size(parts) - 4), "_")
    rest = F.array_join(F.slice(parts, 2, F.size(parts) - 1), "_")
    return F.concat(folder, F.lit("/"), F.regexp_replace(rest, r"_labels\.png$", "_leftImg8bit.png"))


def overlay_mask(overlay: Column, void: Column) -> Column:
    """Per pixel: -1 where the overlay is not zero, else 1 where void, else 0."""
    return F.when(overlay != 0, -1).when(void != 0, 1).otherwise(0)


def blended(original: Column, overlay: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), original + overlay))


def lost_and_found_label(value: Column) -> Column:
    return F.when(value == 1, -1).when(value == 255, 1).otherwise(0)


def street_hazards_annotation(path: Column) -> Column:
    return F.replace(path, F.lit("images"), F.lit("annotations"))


def street_hazards_label(value: Column) -> Column:
    return F.when(value - 1 >= 13, -1).otherwise(value - 1)


def defect_label(mask: Column) -> Column:
    """Inspection images: any positive mask value is an outlier, in whatever integer type the mask comes."""
    return F.when(mask > 0, -1).otherwise(0)


def with_masks(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Images and masks by a parsed key; images without a mask are normal (mask null)."""
    return images.join(masks.select(key, F.col("content").alias("mask")), key, "left")


def _below(path: Column, root: str) -> Column:
    """What a path has after the folder that ``root`` ends with."""
    return F.element_at(F.split(path, re.escape(root.rstrip("/").rsplit("/", 1)[-1] + "/"), 2), -1)


def fishyscapes(spark: SparkSession, root: str, originals: str) -> DataFrame:
    """(path, content, mask, original): overlays ``*_rgb.npz`` with their void labels and street images.

    Files are paired by name, in joins: ``*_labels.png`` beside an overlay, and the original that its name tells, below
    ``originals``. See :func:`overlay_mask` and :func:`blended` for what to do with the pixels.
    """
    over = file_tree(spark, root, "*_rgb.npz").drop("label").withColumn("key", F.regexp_replace(base_name(), r"_rgb\.npz$", ""))
    void = file_tree(spark, root, "*_labels.png").select(F.regexp_replace(base_name(), r"_labels\.png$", "").alias("key"), F.col("content").alias("mask"))
    real = file_tree(spark, originals, "*.png").select(base_name().alias("name"), F.col("content").alias("original"))
    named = over.withColumn("name", F.element_at(F.split(fishyscapes_original(base_name()), "/"), -1))
    return named.join(void, "key").join(real, "name").select("path", "content", "mask", "original")


def lost_and_found(spark: SparkSession, root: str, originals: str) -> DataFrame:
    """(path, content, mask): street images with their outlier labels; see :func:`lost_and_found_label`."""
    masks = file_tree(spark, root, "*_labels.png").select(lost_and_found_original(base_name()).alias("key"), F.col("content").alias("mask"))
    images = file_tree(spark, originals, "*_leftImg8bit.png").select("path", "content", F.concat_ws("/", parent_name(), base_name()).alias("key"))
    return images.join(masks, "key").select("path", "content", "mask")


STREET_HAZARDS = {"test": "test/images", "train": "train/images/training", "validation": "train/images/validation"}


def street_hazards(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(path, content, mask): images with the annotation of the same place below ``annotations``."""
    if split not in STREET_HAZARDS:
        raise ValueError(f"split must be one of {tuple(STREET_HAZARDS)}")
    folder = f"{root.rstrip('/')}/{STREET_HAZARDS[split]}"
    images = file_tree(spark, folder, "*.png").select("path", "content", _below(street_hazards_annotation("path"), root).alias("key"))
    masks = file_tree(spark, street_hazards_folder(folder, root), "*.png").select(_below(F.col("path"), root).alias("key"), F.col("content").alias("mask"))
    return images.join(masks, "key").select("path", "content", "mask")


def street_hazards_folder(folder: str, root: str) -> str:
    top = root.rstrip("/")
    return top + folder[len(top) :].replace("images", "annotations")


def inspection(spark: SparkSession, root: str, split: str, subset: str | None = None) -> DataFrame:
    """(path, content, mask, subset, defect): industrial inspection images, with null masks where nothing is wrong.

    Images are ``<subset>/<split>/<defect>/<n>.png`` and masks ``<subset>/ground_truth/<defect>/<n>_mask.png``.
    """
    if split not in ("train", "test"):
        raise ValueError("split must be train or test")
    key = [parent_name(up=3).alias("subset"), parent_name().alias("defect")]
    d = file_tree(spark, root, "*.png").select("path", "content", *key, parent_name(up=2).alias("part"), F.regexp_replace(base_name(), r"(_mask)?\.png$", "").alias("number"))
    d = d if subset is None else d.where(F.col("subset") == subset)
    masks = d.where("part = 'ground_truth'").select("subset", "defect", "number", F.col("content").alias("mask"))
    return d.where(F.col("part") == split).join(masks, ["subset", "defect", "number"], "left").select("path", "content", "mask", "subset", "defect")


def summed_digits(spark: SparkSession, root: str, split: str = "train", *, member: str = "arr_0") -> DataFrame:
    """(pos, values, target): pictures of four digits with :func:`sum_digits` of their boxes and digits."""
    if split not in ("train", "test"):
        raise ValueError("split must be train or test")
    rows = lambda kind: array_rows(spark, f"{root}/{kind}-{split}.npz", kind="npz", member=member)
    quads = F.transform(F.sequence(F.lit(0), (F.size("values") / 4).cast("int") - 1), lambda k: F.slice("values", k * 4 + 1, 4))
    boxes = rows("b").select("pos", quads.alias("boxes"))
    digits = rows("y").select("pos", F.col("values").alias("digits"))
    d = rows("x").select("pos", "values").join(boxes, "pos").join(digits, "pos")
    return d.select("pos", "values", sum_digits(F.col("boxes"), F.col("digits")).alias("target"))


def sum_digits(boxes: Column, digits: Column) -> Column:
    """Detection targets of summed digits: boxes (x0, x1, y0, y1) to (x0, y0, x1, y1), areas, -1 if the sum is not 20."""
    box = F.transform(boxes, lambda b: F.array(b[0], b[2], b[1], b[3]))
    area = F.transform(boxes, lambda b: (b[1] - b[0]) * (b[3] - b[2]))
    total = F.aggregate(digits, F.lit(0), lambda s, v: s + v.cast("int"))
    return F.struct(box.alias("boxes"), digits.alias("labels"), area.alias("area"), F.when(total == 20, 0).otherwise(-1).alias("anomaly"))


# ---------------------------------------------------------------- generated


def _noise_ids(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    return spark.range(n) if isinstance(n, int) else n.select(F.col("id").cast("bigint").alias("id"))


def uniform_noise(spark: SparkSession, n: int | DataFrame, size: int = 3 * 224 * 224, *, seed: int = 123) -> DataFrame:
    """(id, pixels, label -1): bytes 0-255 from the row's own hash, equal on every partitioning.

    ``n`` is a number of pictures, or a table whose ids get one each, as outliers beside its rows.
    """
    pixel = lambda i: F.floor(V.unit_hash(F.col("id"), i, seed) * 255).cast("int")
    return _noise_ids(spark, n).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), pixel).alias("pixels"), F.lit(-1).alias("label"))


def gaussian_noise(spark: SparkSession, n: int | DataFrame, size: int = 3 * 224 * 224, *, loc: float = 128.0, scale: float = 128.0, seed: int = 123) -> DataFrame:
    def pixel(i: Column) -> Column:
        v = V.normal_hash(F.col("id"), i, seed) * F.lit(scale) + F.lit(loc)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")

    return _noise_ids(spark, n).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), pixel).alias("pixels"), F.lit(-1).alias("label"))
