"""A buffer of scores or features as a table: rows are appended in versions, sampled by key, saved and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, written


def hashed_sample(df: DataFrame, key: str, n: int, *, seed: int = 0, parts: int = 32) -> DataFrame:
    """``n`` rows of each key: those with the smallest hashes of seed and row (a bottom-k sample).

    The rows' own contents decide, so the sample is the same on any partitioning, and samples of parts can be merged by sampling
    their union. A key of any share of the rows is cut down in ``parts`` first. Equal rows count each time.
    """
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    group = F.col(f"row.`{key}`")
    d = whole.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group, "part").orderBy("h"))).where(F.col("rank") <= n)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("h"))).where(F.col("rank") <= n)
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


class ScoreBuffer:
    """Tables of the same columns, gathered under a key column.

    What is appended is written once to the shared folder; nothing is held on the driver or in executors' memory.
    """

    def __init__(self, key: str = "key") -> None:
        self.key = key
        self._parts: list[DataFrame] = []

    def append(self, df: DataFrame) -> ScoreBuffer:
        """Add the rows of ``df``; columns must be those of the first table."""
        if self.key not in df.columns:
            raise ValueError(f"rows need the column {self.key}")
        if self._parts and set(df.columns) != set(self._parts[0].columns):
            raise ValueError("rows have other columns than those before")
        self._parts.append(written(df, "buffer"))
        return self

    def is_empty(self) -> bool:
        return all(p.isEmpty() for p in self._parts)

    def rows(self) -> DataFrame:
        """All rows so far."""
        if not self._parts:
            raise ValueError("nothing was appended")
        out = self._parts[0]
        for p in self._parts[1:]:
            out = out.unionByName(p)
        return out

    def keys(self) -> DataFrame:
        return self.rows().select(self.key).distinct()

    def get(self, key) -> DataFrame:
        """The rows of one key; raises if there are none."""
        found = self.rows().where(F.col(self.key) == F.lit(key))
        if found.isEmpty():
            raise KeyError(key)
        return found

    def __contains__(self, key) -> bool:
        return bool(self._parts) and not self.rows().where(F.col(self.key) == F.lit(key)).isEmpty()

    def sample(self, n: int = 1, *, seed: int = 0) -> DataFrame:
        """``n`` rows of each key (see :func:`hashed_sample`)."""
        return hashed_sample(self.rows(), self.key, n, seed=seed)

    def clear(self) -> ScoreBuffer:
        for p in self._parts:
            discard(p)
        self._parts = []
        return self

    def save(self, path: str) -> ScoreBuffer:
        """Write all rows to ``path``, in folders by key."""
        self.rows().write.mode("overwrite").partitionBy(self.key).parquet(path)
        return self

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "key") -> ScoreBuffer:
        buffer = cls(key)
        buffer._parts = [spark.read.parquet(path)]
        return buffer
