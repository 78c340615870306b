"""Contiguous, byte-balanced shards from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

#: Sampled order keys for each range; the sample only decides how even the ranges are, never a shard.
KEYS_PER_RANGE = 64
OVERHEAD = 16


def _range_bounds(keys: DataFrame, n_ranges: int) -> list[int]:
    """Up to ``n_ranges - 1`` ascending cut points of a bounded sample (``KEYS_PER_RANGE`` for each range)."""
    total = keys.count()
    want = n_ranges * KEYS_PER_RANGE
    picked = keys.where(F.col("k").isNotNull())
    if total > want:
        picked = picked.sample(min(1.0, want / total), seed=17)
    got = sorted(r.k for r in picked.limit(4 * want).collect())
    return [got[len(got) * i // n_ranges] for i in range(1, n_ranges)] if got else []


def _below(bounds: list[int], key: Column, strict: bool) -> Column:
    """How many ascending bounds are below ``key`` (or equal to it, unless ``strict``): a binary search; null keys: 0.

    One expression whose length grows with the logarithm of the bounds' number, and never null, so that no null check
    of it is derived and pushed towards the scan.
    """
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folds to one literal
    top = len(bounds).bit_length() - 1
    steps = F.split(F.lit(",".join(str(1 << k) for k in range(top, -1, -1))), ",").cast("array<int>")

    def halve(at: Column, step: Column) -> Column:
        bound = F.get(table, at + step - 1)
        return at + F.when((bound < key) if strict else (bound <= key), step).otherwise(0)

    return F.coalesce(F.aggregate(steps, F.lit(0), halve), F.lit(0))


def with_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None, keep: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """Deal rows, in order of ``id_col`` (or of the bigint ``order``), to ``n_shards`` contiguous shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 16. The global order is id (nulls first), then a
    hash of the text. Rows are dealt to ranges of the order; each range's total gives its offset (the prefix sum over
    the totals), a window inside each range gives the rest. The shard is where the middle of the row's bytes falls
    among ``n_shards`` equal targets, so shards are contiguous and differ from the target by one row at most.

    * null or empty text: size 16; empty table: no rows; null ids are at the front, in ranges of their own;
    * a very long text may by itself exceed a target; shards without any middle stay empty, none is ever split;
    * rows repeated in full are neighbours in any order among themselves. An id shared by very many rows is spread over
      the ranges that its value spans, and null ids over all of theirs, by the hash of the text and by the partition that
      a row is read in; within a range, rows with equal id and text are numbered a partition at a time. So ``docs`` should
      be a table or a scan, whose rows stay in their partitions when it is read again;
    * columns of the input are carried in a struct, so their names never clash; ``shard``, ``slot`` and ``size`` of the
      input are replaced by the new columns.

    ``keep`` names the columns to carry (default: all). Returns them plus ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard). No grouping of
    equal texts is kept: the cuts follow bytes alone.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or min(8192, max(64, 4 * parts(spark)))
    order = F.col(f"`{id_col}`").cast("bigint") if order is None else order
    bounds = _range_bounds(docs.select(order.alias("k")), n_ranges)
    own = [c for c in keep or docs.columns if c not in ("size", "shard", "slot")]
    text = F.col(f"`{text_col}`")
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        order.alias("_k"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("bigint").alias("_size"),
        F.xxhash64(text).alias("_h"),
        F.spark_partition_id().alias("_p"),
    )
    d = d.withColumn("_lo", _below(bounds, F.col("_k"), strict=True)).withColumn("_hi", _below(bounds, F.col("_k"), strict=False))
    mixed = F.pmod(F.xxhash64("_h", "_p"), F.when(F.col("_k").isNull(), F.lit(n_ranges)).otherwise(F.col("_hi") - F.col("_lo") + 1).cast("bigint"))
    d = d.withColumn("_range", F.when(F.col("_k").isNull(), -1 - mixed).otherwise(F.col("_lo") + mixed).cast("int"))
    totals = d.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 2 n_ranges rows at most
    everything = Window.partitionBy(F.lit(1))
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_row0"),
        F.sum("bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("_k").asc_nulls_first(), "_h", "_p")
    d = (
        d.withColumn("_end", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
    )
    # the middle of the row's bytes, in whole numbers (total bytes times shards stay below 2^62)
    d = d.selectExpr(
        "_row",
        "_size",
        f"CAST(((_byte0 + _end) * 2 - _size) * {int(n_shards)} DIV (_total * 2) AS INT) AS _shard",
        "_row0 + _rank - 1 AS _at",
    )
    firsts = d.groupBy("_shard").agg(F.min("_at").alias("_first"))
    d = d.join(F.broadcast(firsts), "_shard")
    return d.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in own],
        F.col("_size").alias("size"),
        F.col("_shard").alias("shard"),
        (F.col("_at") - F.col("_first")).cast("bigint").alias("slot"),
    )


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The contract's digest of :func:`with_shards`: law ``bytes``; nothing depends on a key, so grown_shard is null."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    s = with_shards(docs.select("doc_id", "text", crc.alias("text_crc32")), n_shards, keep=["doc_id", "text_crc32"])
    return s.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_prefix_sum_shards(spark, sf_dir: str) -> DataFrame:
    return shard_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Ids are distinct in the table, so their order alone places each row; crc32 by a table of 256 entries, which the first two
#: queries make, over the UTF-8 bytes of each text.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
     UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
     crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
     points AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS u FROM documents WHERE text <> ''),
     bytes AS (SELECT doc_id, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] WHEN x < 2048 THEN [192 + (x >> 6), 128 + (x & 63)]
                      WHEN x < 65536 THEN [224 + (x >> 12), 128 + ((x >> 6) & 63), 128 + (x & 63)]
                      ELSE [240 + (x >> 18), 128 + ((x >> 12) & 63), 128 + ((x >> 6) & 63), 128 + (x & 63)] END)) AS b FROM points),
     hashed AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, crc),
     sized AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size FROM documents),
     placed AS (SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total FROM sized),
     dealt AS (SELECT doc_id, size, CAST((2 * upto - size) * 40 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, coalesce(h, 0) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM dealt LEFT JOIN hashed USING (doc_id)
"""
