"""The common setup of the registered queries: embeddings, a nearest-centre head and its logits.

Labels 8 and 9 are outliers (-1). Known rows of even ids train; every row is scored. The head's weights are the training
class means and its bias is minus half their squared norm, so its largest logit names the nearest centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.moments import class_means


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    y = F.when(F.col("label") < 8, F.col("label")).otherwise(-1).cast("int")
    return e.select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("z"), y.alias("y"))


@dataclass
class Setup:
    e: DataFrame
    w: np.ndarray
    b: np.ndarray

    @property
    def train(self) -> DataFrame:
        return self.e.where("id % 2 = 0 AND y >= 0")


def setup(spark: SparkSession, sf_dir: str) -> Setup:
    """Rows carry id, z (features), y (label) and l (logits)."""
    e = embeddings(spark, sf_dir)
    means = class_means(e.where("id % 2 = 0 AND y >= 0"), "z", "y")
    w = np.stack([means[k][1] for k in sorted(means)])
    b = -(w * w).sum(1) / 2
    return Setup(e.withColumn("l", V.linear("z", w, b)), w, b)


#: The same setup in SQL: e, tr, te, h (class, weights, bias), la (all rows with logits), lt (train), lg (scored: all).
SQL = """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS z, CAST(CASE WHEN label < 8 THEN label ELSE -1 END AS INTEGER) AS y FROM embeddings),
cl AS (SELECT y AS k, i, avg(z[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) WHERE id % 2 = 0 AND y >= 0 GROUP BY y, i),
h AS (SELECT k, list(m ORDER BY i) AS w FROM cl GROUP BY k),
la0 AS (SELECT id, y, any_value(z) AS z, list(list_inner_product(z, w) - 0.5::DOUBLE * list_inner_product(w, w) ORDER BY k) AS l,
        list(list_inner_product(z, z) - 2::DOUBLE * list_inner_product(z, w) + list_inner_product(w, w) ORDER BY k) AS d FROM e, h GROUP BY id, y),
la1 AS (SELECT *, list_max(l) AS m FROM la0),
la AS (SELECT *, m + ln(list_sum([exp(x - m) for x in l])) AS lse, list_position(l, m) - 1 AS yhat FROM la1),
lt AS (SELECT * FROM la WHERE id % 2 = 0 AND y >= 0),
lg AS (SELECT * FROM la)"""
