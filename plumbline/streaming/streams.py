"""Structured Streaming forms of the incremental operators: scoring, metrics, running centres, multipliers, queues, virtual outliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vectors as V
from ..operators.base import Detector
from ..operators.centers import SUMS, class_center_table, last_rows, outliers_from_sums, queue_sums
from ..operators.losses import EnergyMarginLoss
from ..operators.metrics import curve_metrics
from ..operators.moments import class_means
from .state import Versions, folded


def score_stream(stream: DataFrame, detector: Detector, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score a stream with a fitted detector into a Parquet table: a projection, so no state is kept."""
    scored = detector.predict_features(stream)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def metrics_of_stream(stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, *, score: str = "score", label: str = "label", table: str, **trigger) -> StreamingQuery:
    """Count scores; after each batch hand the metrics of all rows so far to ``sink``.

    What is stored are running counts of equal scores, one version a batch: a batch reads the last version before it and
    writes the merged one, so its work follows the number of distinct scores and not that of earlier batches. A batch that
    runs again makes its version anew. Only the last two versions stay.
    """

    def fold(batch: DataFrame, number: int) -> None:
        versions, far = Versions(batch.sparkSession, table), F.col(label) < 0
        counts = batch.groupBy(F.col(score).cast("double").alias("_s")).agg(F.sum(far.cast("bigint")).alias("p"), F.sum((~far).cast("bigint")).alias("n"))
        before = versions.before(number)
        if before is not None:
            counts = counts.unionByName(before).groupBy("_s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        sink(curve_metrics(versions.put(number, counts), on_missing="null"))

    return folded(stream, fold, checkpoint, **trigger)


#: The row of a table of running centres that holds the number of batches.
COUNTER = -1


def folded_centers(batch: DataFrame, before: DataFrame | None, features: str = "features", label: str = "label") -> DataFrame:
    """(label, center, batches) after one more batch, as :class:`RunningCenters` folds it; label COUNTER is the batch count.

    Both sides are tables, joined by class, so the number of classes isn't bounded by the driver.
    """
    spark = batch.sparkSession
    old = spark.createDataFrame([(COUNTER, None, 0)], "label int, center array<double>, batches bigint") if before is None else before
    n = old.where(F.col("label") == COUNTER).first().batches
    mu = class_center_table(batch, features, label).select("label", F.col("center").alias("mu"))
    both = old.where(F.col("label") != COUNTER).select("label", "center").join(mu, "label", "full")
    zero = F.transform("mu", lambda _: F.lit(0.0))
    moved = F.zip_with("mu", F.coalesce("center", zero), lambda m, c: (m + c * F.lit(float(n))) / F.lit(float(n + 1)))
    done = both.select("label", F.when(F.col("mu").isNull(), F.col("center")).otherwise(moved).alias("center"), F.lit(n + 1).cast("bigint").alias("batches"))
    return done.unionByName(spark.createDataFrame([(COUNTER, None, n + 1)], "label int, center array<double>, batches bigint"))


def running_center_stream(stream: DataFrame, table: str, checkpoint: str, *, features: str = "features", label: str = "label", **trigger) -> StreamingQuery:
    """Fold each micro-batch into the running centres below ``table`` (see :func:`centers_of`); a restarted stream goes on with them."""

    def fold(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, table)
        versions.put(number, folded_centers(batch, versions.before(number), features, label))

    return folded(stream, fold, checkpoint, **trigger)


def centers_of(spark: SparkSession, table: str) -> DataFrame:
    """(label, center, batches) of the last batch."""
    latest = Versions(spark, table).latest()
    if latest is None:
        raise ValueError("no batch has come yet")
    return latest.where(F.col("label") != COUNTER)


def multiplier_stream(stream: DataFrame, loss: EnergyMarginLoss, table: str, checkpoint: str, *, logits: str = "logits", label: str = "label", weight: float, bias: float, how: dict | None = None, **trigger) -> StreamingQuery:
    """Step both constraints of ``loss`` once a micro-batch. Multipliers and penalties are versions below ``table``.

    They begin as in ``loss``; a restarted stream takes up those of its last whole batch, whatever ``loss`` holds.
    """
    begin = {k: (c.multiplier, c.penalty) for k, c in (("alarms", loss.alarms), ("fit", loss.fit))}

    def fold(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, table)
        before = versions.before(number)
        now = begin if before is None else {r.name: (r.multiplier, r.penalty) for r in before.collect()}  # two rows
        for name, constraint in (("alarms", loss.alarms), ("fit", loss.fit)):
            constraint.multiplier, constraint.penalty = now[name]
        if not batch.where(F.col(label) >= 0).isEmpty():
            loss.step(batch, logits, label, weight=weight, bias=bias, **(how or {}))
        rows = [(k, float(c.multiplier), float(c.penalty)) for k, c in (("alarms", loss.alarms), ("fit", loss.fit))]
        versions.put(number, batch.sparkSession.createDataFrame(rows, "name string, multiplier double, penalty double"))

    return folded(stream, fold, checkpoint, **trigger)


def virtual_outlier_stream(stream: DataFrame, sink: Callable[[DataFrame], None], table: str, checkpoint: str, *, n: int, features: str = "features", label: str = "label", sequence: str = "id", sample_from: int = 10_000, select: int = 1, seed: int = 0, **trigger) -> StreamingQuery:
    """Queues of the last ``n`` rows a class, and after each batch virtual outliers of the queued rows, handed to ``sink``.

    Sums and products of the queues are kept beside them: rows that enter are added and rows that leave are taken away, so a
    batch's work follows its own rows. Products are about the first batch's mean, which keeps their precision.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        queues, sums = Versions(spark, f"{table}/queue"), Versions(spark, f"{table}/sums")
        old, totals = queues.before(number), sums.before(number)
        mark = F.concat_ws("-", F.lit(number), F.monotonically_increasing_id())  # names a row in the stored versions only
        rows = batch.where(F.col(label) >= 0).select(F.col(label).cast("int").alias("label"), F.col(sequence).cast("bigint").alias("at"), V.doubles(features).alias("z"), mark.alias("mark")).where("z IS NOT NULL")
        rows = rows if old is None else rows.unionByName(old)
        new = queues.put(number, last_rows(rows, "label", "at", n))
        entered = new.where(F.col("mark").startswith(f"{number}-"))
        origin = None if totals is None else totals.where("kind = 2").orderBy("pos").toPandas()["x"].to_numpy()
        if origin is None or not len(origin):
            mean = class_means(entered, "z", F.lit(0))
            if not mean:
                sums.put(number, spark.createDataFrame([], SUMS))
                return
            origin = mean[0][1]
        change = queue_sums(entered, origin, 1)
        if old is not None:
            change = change.unionByName(queue_sums(old.join(new.select("mark"), "mark", "left_anti"), origin, -1))
        if totals is not None:
            change = change.unionByName(totals.where("kind < 2"))
        done = change.groupBy("kind", "key", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        first = spark.createDataFrame([(2, 0, k, 0, float(x)) for k, x in enumerate(origin)], SUMS)
        sink(outliers_from_sums(sums.put(number, done.unionByName(first)), sample_from=sample_from, select=select, seed=seed))

    return folded(stream, fold, checkpoint, **trigger)


def last_n_stream(stream: DataFrame, key: str, sequence: str, value: str, n: int) -> DataFrame:
    """Keyed state: the last ``n`` (sequence, value) pairs of each key; every update emits the key's queue.

    The state of a key is ``n`` pairs, whatever number of rows arrives.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, val = (list(x) for x in (state.get if state.exists else ([], [])))
        for f in frames:
            rows = sorted(zip(seq + f[sequence].tolist(), val + f[value].tolist()))[-n:]
            seq, val = [r[0] for r in rows], [r[1] for r in rows]
        state.update((seq, val))
        yield pd.DataFrame({"key": [str(k[0])], "sequence": [seq], "value": [val]})

    d = stream.select(F.col(key).alias(key), F.col(sequence).cast("bigint").alias(sequence), F.col(value).cast("double").alias(value))
    return d.groupBy(key).applyInPandasWithState(update, "key string, sequence array<bigint>, value array<double>", "sequence array<bigint>, value array<double>", "update", GroupStateTimeout.NoTimeout)


__all__ = ["centers_of", "folded_centers", "last_n_stream", "metrics_of_stream", "multiplier_stream", "running_center_stream", "score_stream", "virtual_outlier_stream"]
