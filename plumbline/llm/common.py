"""Helpers that the corpus operators share: scratch tables, checked broadcasts, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be broadcast: about 10 MB.
BROADCAST_ROWS = 200_000
#: Rows and bytes of an Arrow batch of whole texts, whatever default the session has; a longer text is a batch of its own.
TEXT_ROWS, TEXT_BYTES = 1_000, 4 << 20
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL[app]


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> Iterator[None]:
    """Jobs that start in here send at most ``rows`` rows and about ``size`` bytes at a time to Python, for rows that hold whole texts."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in bounds}
    for name, most in bounds.items():
        now = int(before[name]) if before[name].lstrip("-").isdigit() else 0
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, *, texts: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    With ``texts``, Python functions in it get batches of few rows (see :func:`text_batches`).
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    with text_batches(spark) if texts else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once no later result reads it."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has ``limit`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col: Column) -> Column:
    """crc32 of a column as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
