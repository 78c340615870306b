"""State of a stream as versions of a table, one a batch: a batch reads the version before it and writes its own.

A batch that runs again after a restart reads the same version as the first time and replaces what it wrote, so each
batch counts once. Nothing is kept on the driver. The version of a batch and the one before it stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class Versions:
    """Versions ``v0``, ``v1``, ... of a table below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions that were written to the end, in order."""
        top = self._path(self.folder)
        names = [f.getPath().getName() for f in self._store.listStatus(top)] if self._store.exists(top) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._store.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{number}")

    def before(self, number: int) -> DataFrame | None:
        """The last version of an earlier batch."""
        earlier = [n for n in self.numbers() if n < number]
        return self._read(earlier[-1]) if earlier else None

    def latest(self) -> DataFrame | None:
        every = self.numbers()
        return self._read(every[-1]) if every else None

    def put(self, number: int, df: DataFrame) -> DataFrame:
        """Write the version of a batch, in place of one that an earlier try may have left; drop those that no try can need."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v{number}")
        for old in [n for n in self.numbers() if n < number][:-1]:
            self._store.delete(self._path(f"{self.folder}/v{old}"), True)
        return self._read(number)


def folded(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start ``fold(batch, number)`` on each micro-batch."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
