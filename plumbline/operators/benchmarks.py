"""The published benchmarks by name: which tables are known, which are outliers, and where their files are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .splits import Benchmark

Reader = Callable[[SparkSession, str], DataFrame]


def _noise(make) -> Reader:
    def read(spark: SparkSession, root: str) -> DataFrame:
        return make(spark, 1000, 3 * 32 * 32).select(F.col("pixels").alias("content"), "label")

    return read


def _folder(name: str, sub: str) -> Reader:
    return lambda spark, root: files.outlier_folder(spark, name, f"{root}/{sub}")


# Folders that the published archives unpack to.

#: Outlier tables by name, from the folder that holds all data sets.
OUTLIERS: dict[str, Reader] = {
    "TinyImageNetCrop": _folder("TinyImageNetCrop", "Imagenet/test"),
    "TinyImageNetResize": _folder("TinyImageNetResize", "Imagenet_resize/Imagenet_resize"),
    "LSUNCrop": _folder("LSUNCrop", "LSUN/test"),
    "LSUNResize": _folder("LSUNResize", "LSUN_resize/LSUN_resize"),
    "UniformNoise": _noise(files.uniform_noise),
    "GaussianNoise": _noise(files.gaussian_noise),
    "CIFAR10": lambda spark, root: files.cifar_records(spark, f"{root}/cifar-10-batches-bin", False),
    "CIFAR100": lambda spark, root: files.cifar_records(spark, f"{root}/cifar-100-binary", False, classes=100),
    "TinyImageNet": lambda spark, root: files.tiny_imagenet(spark, f"{root}/tiny-imagenet-200", "val"),
    "MNIST": lambda spark, root: files.idx_images(spark, f"{root}/MNIST/raw", False),
    "FashionMNIST": lambda spark, root: files.idx_images(spark, f"{root}/FashionMNIST/raw", False),
    "Textures": _folder("Textures", "dtd/images"),
    "Places365": _folder("Places365", "places365"),
    "ImageNetO": lambda spark, root: files.imagenet_variant(spark, f"{root}/imagenet-o"),
    "OpenImagesO": lambda spark, root: files.open_images_o(spark, f"{root}/openimage_o/images", f"{root}/openimage_o/inclusion.json"),
    "SVHN": lambda spark, root: files.file_tree(spark, f"{root}/svhn/test", "*.png"),
}

_CROPS = ("TinyImageNetCrop", "TinyImageNetResize", "LSUNResize", "LSUNCrop", "UniformNoise", "GaussianNoise")
_OPEN = ("TinyImageNet", "MNIST", "FashionMNIST", "Textures", "Places365")

#: Benchmark to its known tables (test, train) and the names of its outlier tables.
BENCHMARKS: dict[str, tuple[Reader, Reader, tuple[str, ...]]] = {}
for _n, _dir, _other in ((10, "cifar-10-batches-bin", "CIFAR100"), (100, "cifar-100-binary", "CIFAR10")):
    _known = [lambda spark, root, n=_n, d=_dir, train=train: files.cifar_records(spark, f"{root}/{d}", train, classes=n) for train in (False, True)]
    BENCHMARKS[f"CIFAR{_n}_ODIN"] = (*_known, _CROPS)
    BENCHMARKS[f"CIFAR{_n}_OpenOOD"] = (*_known, (_other, *_OPEN))
BENCHMARKS["ImageNet_OpenOOD"] = (
    lambda spark, root: files.class_tree(spark, f"{root}/imagenet/val", "*.JPEG"),
    lambda spark, root: files.class_tree(spark, f"{root}/imagenet/train", "*.JPEG"),
    ("ImageNetO", "OpenImagesO", "Textures", "SVHN", "MNIST"),
)


def named_benchmark(spark: SparkSession, name: str, root: str, transform: Callable[[DataFrame], DataFrame], *, outliers: tuple[str, ...] | None = None) -> Benchmark:
    """The benchmark ``name`` over the data sets below ``root``; ``evaluate`` takes a detector on ``transform``'s columns.

    ``transform`` turns a table with ``content`` (a file's bytes, a record's bytes, or an array of numbers from 0 to 255) and ``label`` into
    one that a detector reads, for instance by decoding and a model. ``outliers`` picks some of the outlier tables. Images
    that also show known classes aren't excluded, as in the published form.
    """
    if name not in BENCHMARKS:
        raise ValueError(f"benchmark must be one of {tuple(BENCHMARKS)}")
    test, train, every = BENCHMARKS[name]
    chosen = every if outliers is None else outliers
    if set(chosen) - set(every):
        raise ValueError(f"outliers of {name} are {every}")
    read = lambda reader: transform(reader(spark, root).select("content", "label"))
    return Benchmark(read(test), {k: read(OUTLIERS[k]) for k in chosen}, read(train))
