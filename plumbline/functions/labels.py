"""Label expressions: labels of 0 and above are known (in-distribution), labels below 0 are unknown (outliers)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import Vector, col


def is_known(label: Vector) -> Column:
    return col(label) >= 0


def is_unknown(label: Vector) -> Column:
    return col(label) < 0


def contains_known(label: Vector) -> Column:
    """Aggregate: whether any label is known (false for no rows)."""
    return F.coalesce(F.bool_or(is_known(label)), F.lit(False))


def contains_unknown(label: Vector) -> Column:
    return F.coalesce(F.bool_or(is_unknown(label)), F.lit(False))


def contains_known_and_unknown(label: Vector) -> Column:
    return contains_known(label) & contains_unknown(label)


def to_unknown() -> Column:
    return F.lit(-1)


class TargetMapping:
    """Class labels to training labels: known classes to 0, 1, ... in ascending order, unknown ones below zero.

    Unknown class c becomes ``-c - 1``; with ``compat`` it becomes ``-c``, which makes unknown class 0 a known label.
    Other labels give -1, or an error if ``strict``.
    """

    def __init__(self, known: Iterable[int], unknown: Iterable[int] = (), *, compat: bool = False) -> None:
        self.table = {c: i for i, c in enumerate(sorted(set(known)))}
        self.table |= {c: -c if compat else -c - 1 for c in sorted(set(unknown))}

    def __call__(self, label: Vector, *, strict: bool = False) -> Column:
        other = F.raise_error(F.concat(F.lit("unmapped label "), col(label).cast("string"))).cast("int") if strict else F.lit(-1)
        if not self.table:
            return other
        pairs = [F.lit(x) for kv in self.table.items() for x in kv]
        got = F.try_element_at(F.create_map(*pairs), col(label).cast("int"))
        return F.when(got.isNotNull(), got).otherwise(other)

    def __getitem__(self, label: int) -> int:
        return self.table[label]

    def items(self):
        return self.table.items()


#: Sampled values from which ranges are cut, and the number of ranges; they only decide the balance.
SAMPLED, RANGES = 4096, 64


def dense_labels(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Number the distinct values of ``by`` from 0 in ascending order; nulls stay null.

    The distinct values are cut into ranges; each range's count gives its offset and a window numbers the values inside,
    so no task orders all values. Columns of ``df`` are carried in a struct.
    """
    own = [c for c in df.columns if c != label]
    value = F.col(f"`{by}`")
    named = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    some = sorted(r.value for r in named.orderBy(F.xxhash64("value")).limit(SAMPLED).collect())
    cuts = [some[len(some) * i // RANGES] for i in range(1, RANGES)] if len(some) == SAMPLED else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("value"))) if cuts else F.lit(0)
    ranged = named.withColumn("place", place)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = ranged.groupBy("place").agg(F.count("*").alias("n")).select("place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("place").orderBy("value")) - 1
    named = ranged.withColumn("at", at).join(F.broadcast(offsets), "place").select("value", (F.col("at") + F.col("offset")).cast("int").alias("number"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    joined = rows.join(named, F.col(f"row.`{by}`") == F.col("value"), "left")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("number").alias(label))
