"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, parts, small

#: Production weights: the hot source is held to two parts, every other source gets one.
TARGET_WEIGHTS = {"src0": 2.0}
DEFAULT_WEIGHT = 1.0
SEED = "mix-1"
SALTS = 32


def _digits(key: Column) -> Column:
    """The first 13 hex digits of an md5 as a whole number (52 bits)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")


def poisson_table(rate: Column) -> Column:
    """Array of (k, P(X <= k)) for a Poisson mean, from where the mass begins to where it ends.

    Means up to 600 begin at 0; larger ones at mean - 12 deviations, where ln k! comes from Stirling's series. The
    array has about 24 deviations, so its length grows with the root of the mean only.
    """
    lo = F.when(rate <= 600, F.lit(0.0)).otherwise(F.floor(rate - 12 * F.sqrt(rate)).cast("double"))
    hi = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("bigint")
    n = lo
    stirling = n * F.log(n) - n + F.log(n * 6.283185307179586) / 2 + 1 / (n * 12) - 1 / (n * n * n * 360)
    first = F.when(lo == 0, -rate).otherwise(-rate + n * F.log(rate) - stirling)
    zero = F.struct(first.alias("lp"), F.exp(first).alias("sum"), F.array(F.struct(lo.cast("bigint").alias("k"), F.exp(first).alias("p"))).alias("at"))

    def grow(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("sum"), F.concat(acc["at"], F.array(F.struct(k.alias("k"), total.alias("p")))).alias("at"))

    return F.aggregate(F.sequence(lo.cast("bigint") + 1, hi), zero, grow, lambda acc: acc["at"])


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, size: Column, total: float = 1.0) -> DataFrame:
    """One row a source: its size, weight and the mean number of copies that brings it to its share of the target.

    The target size is ``total`` times the size of the input. A weight of 0 (or a source of size 0) gives rate 0.
    """
    table = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]) if weights else None
    named = F.lit(None).cast("double") if table is None else F.try_element_at(table, F.col("source"))
    sizes = docs.groupBy("source").agg(F.sum(size).cast("bigint").alias("source_size"))
    sizes = sizes.withColumn("weight", F.coalesce(named, F.lit(float(default_weight))))
    both = sizes.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    whole, weight = float(both.s or 0), float(both.w or 0)
    rate = F.col("weight") * (whole * total / weight if weight else 0.0) / F.col("source_size")
    return sizes.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("weight") > 0), rate).otherwise(0.0))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, *, seed: str = SEED, total: float = 1.0) -> DataFrame:
    """Repeat or drop documents so that sources reach target shares of the bytes, in a global random order.

    Each document's count is the inverse of the Poisson distribution with its source's mean rate, at a point hashed
    from the seed and doc_id, so it doesn't depend on partitions or retries. Rows are exploded by their count and
    sorted by a hash of seed, doc_id and copy. Hashes are even, so equal ranges of them are balanced partitions, in
    order, without a sample pass over the rows.

    * null source: a source of its own; null or empty text: one byte, so that it has a size;
    * null doc_id: the hash of the text takes its place;
    * rows that share an id (or, without ids, a text) are told apart by where they are read, so each has a count and places of
      its own and their mean is still the rate; ``docs`` should then be a table or a scan, which is read the same way again;
    * a very long text is as long in each copy; empty table: no rows;
    * columns of the input that clash with ``copy``, ``copies``, ``rate`` or ``shuffle_key`` are replaced.

    The table of sources is broadcast only if it has few rows, counted; beyond that the hot sources are salted.
    """
    weights = TARGET_WEIGHTS if weights is None else weights
    own = [c for c in docs.columns if c not in ("copy", "copies", "rate", "shuffle_key")]
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0)))
    rates = source_rates(docs, weights, default_weight, size, total)
    table = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.when(F.col("rate") > 0, poisson_table(F.greatest(F.col("rate"), F.lit(1e-300)))).alias("_cdf"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("source").alias("_s"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_id"))
    twins = d.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_id").alias("_twin"))
    if not twins.isEmpty():
        d = d.withColumn("_read", F.monotonically_increasing_id()).join(small(twins), F.col("_id") == F.col("_twin"), "left")
        d = d.withColumn("_id", F.when(F.col("_twin").isNull(), F.col("_id")).otherwise(F.concat_ws(":", "_id", "_read"))).drop("_read", "_twin")
    if table.limit(BROADCAST_ROWS // 100 + 1).count() <= BROADCAST_ROWS // 100:
        d = d.join(F.broadcast(table), F.col("_s").eqNullSafe(F.col("_source")))
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("_dealt", F.pmod(F.hash("_id"), F.lit(SALTS))).join(salted, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_dealt") == F.col("_salt")))
    u = (_digits(F.concat(F.lit(seed + ":"), F.col("_id"))) + F.lit(0.5)) / F.lit(float(2**52))
    d = d.withColumn("_u", u)
    below = F.filter("_cdf", lambda e: e["p"] < F.col("_u"))
    d = d.withColumn("_n", F.when(F.col("_rate") > 0, F.element_at("_cdf", 1)["k"] + F.size(below)).otherwise(0).cast("int"))
    d = d.where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    d = d.withColumn("_key", _digits(F.concat(F.lit(seed + ":"), F.col("_id"), F.lit(":"), F.col("copy").cast("string"))))
    n = parts(docs.sparkSession)
    place = F.floor(F.col("_key") / F.lit(float(2**52)) * n).cast("int")
    return d.repartitionById(n, place).sortWithinPartitions("_key").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in own],
        "copy",
        F.col("_n").alias("copies"),
        F.col("_rate").alias("rate"),
        F.col("_key").alias("shuffle_key"),
    )


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).withColumn("rate", F.round("rate", 6))


ORACLE = f"""
WITH sized AS (SELECT *, greatest(1, coalesce(strlen(text), 0)) AS b FROM documents),
     per AS (SELECT source, CAST(sum(b) AS BIGINT) AS source_size,
                    CASE WHEN source = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
             FROM sized GROUP BY source),
     rated AS (SELECT source, weight * ((SELECT sum(source_size) FROM per)::DOUBLE * 1.0::DOUBLE
                      / (SELECT sum(weight) FROM per)) / source_size AS rate FROM per),
     mass AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
              FROM rated, (SELECT unnest(range(0, 900)) AS k)),
     cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
     placed AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
                       (('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
                FROM documents d),
     counted AS (SELECT p.doc_id, any_value(p.text) AS text, any_value(p.lang) AS lang, any_value(p.source) AS source,
                        any_value(p.n_chars) AS n_chars, any_value(c.rate) AS rate, CAST(count(*) FILTER (c.c < p.u) AS INTEGER) AS copies
                 FROM placed p JOIN cdf c ON p.source IS NOT DISTINCT FROM c.source
                 WHERE c.k <= c.rate + 12 * sqrt(c.rate) + 20 GROUP BY p.doc_id),
     copied AS (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, copies, round(rate, 6) AS rate,
       ('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key
FROM copied
"""
