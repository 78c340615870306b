"""Exact deduplication on a log-structured merge index of text digests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, materialize, small

#: Entries that a task's memtable holds before it is flushed as a sorted run.
MEMTABLE_ROWS = 1 << 20
#: Tables of a level before they are merged into one of the next.
FANOUT = 4
#: Bits and hash functions of a filter's entry; bits of the largest filter (16 MB), which goes to every executor.
BITS, HASHES, FILTER_BITS = 10, 4, 1 << 27
#: Copies of a run that is joined by shuffle.
SALTS = 16
_NONE = np.iinfo(np.int64).max
_RUN = "digest bigint, min_id bigint, n bigint"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _flushed(digests: list[np.ndarray], ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """A memtable as a run: one entry a digest, ascending, with its smallest identifier and number of rows."""
    d, i, n = np.concatenate(digests), np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(d, kind="stable")
    d, i, n = d[order], i[order], n[order]
    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(i, at) if len(d) else i
    total = np.add.reduceat(n, at) if len(d) else n
    return pa.record_batch([pa.array(d[at]), pa.array(low, mask=low == _NONE), pa.array(total)], names=["digest", "min_id", "n"])


def _memtable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests, ids, counts, held = [], [], [], 0
    for b in batches:
        digests.append(b.column(0).to_numpy(zero_copy_only=False))
        ids.append(b.column(1).fill_null(_NONE).to_numpy(zero_copy_only=False))
        counts.append(np.ones(b.num_rows, np.int64))
        held += b.num_rows
        if held >= MEMTABLE_ROWS:
            yield _flushed(digests, ids, counts)
            digests, ids, counts, held = [], [], [], 0
    if held:
        yield _flushed(digests, ids, counts)


class DigestFilter:
    """Bloom filter of a run's digests: HASHES bits each, BITS bits of filter an entry, never more than FILTER_BITS in all.

    A digest's bits follow from its two halves. They are set by a distributed aggregate over 64-bit words; what reaches the
    driver is the filter alone. Larger runs than FILTER_BITS allows for get a fuller filter, which rejects less.
    """

    def __init__(self, run: DataFrame) -> None:
        self.size = min(FILTER_BITS, max(64, -(-run.count() * BITS // 64) * 64))
        low, high = F.col("digest").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("digest", 32)
        bits = F.array(*[F.pmod(low + high * F.lit(i), F.lit(self.size)) for i in range(HASHES)])
        words = run.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        got = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("mask")).toArrow()
        words = np.zeros(self.size // 64, np.int64)
        words[got["word"].to_numpy()] = got["mask"].to_numpy()
        self.words = run.sparkSession.sparkContext.broadcast(words)

    def may_hold(self, digest: Column) -> Column:
        size, shared = self.size, self.words

        @pandas_udf("boolean")
        def held(d: pd.Series) -> pd.Series:
            d = d.to_numpy(np.int64).view(np.uint64)
            low, high, out = d & np.uint64(0xFFFFFFFF), d >> np.uint64(32), np.ones(len(d), bool)
            for i in range(HASHES):
                bit = (low + high * np.uint64(i)) % np.uint64(size)
                out &= (shared.value[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(out)

        return held(digest)


class MergeIndex:
    """Digest runs in the shared folder, in levels. ``flush`` adds a level-0 table of the tasks' memtables as sorted runs;
    FANOUT tables of a level are merged into one of the next. Merging keeps the smallest identifier and the summed count of
    each digest; memtables have already folded a group's copies to one entry a task, so no digest is hot.
    """

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = [[]]

    def flush(self, digests: DataFrame) -> None:
        """``digests`` has (digest bigint, doc_id bigint)."""
        self.levels[0].append(materialize(digests.select("digest", "doc_id").mapInArrow(_memtable, _RUN), "run"))
        k = 0
        while len(self.levels[k]) >= FANOUT:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._merged(self.levels[k]))
            self.levels[k] = []
            k += 1

    def _merged(self, tables: list[DataFrame]) -> DataFrame:
        runs = reduce(DataFrame.unionByName, tables)
        merged = runs.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        merged = materialize(merged, "level")
        for table in tables:
            discard(table)
        return merged

    def entries(self) -> DataFrame:
        """All levels compacted into one run, sorted by digest within its files: one entry a digest."""
        tables = [t for level in self.levels for t in level]
        if not tables:
            raise ValueError("nothing was flushed")
        self.levels = [[], [self._merged(tables)]]
        return self.levels[1][0]


def looked_up(rows: DataFrame, run: DataFrame, held: DigestFilter, on: list[str], how: str = "inner") -> DataFrame:
    """Rows that the filter lets pass, joined with the run.

    A run that is too large to broadcast is replicated by SALTS, and rows are dealt to its copies, so that a digest which
    very many rows share is spread.
    """
    maybe = rows.where(held.may_hold(F.col("digest")))
    near = small(run)
    if near is not run:
        return maybe.join(near, on, how)
    spread = run.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return maybe.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(spread, [*on, "salt"], how).drop("salt")


def dedup_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after :func:`normalised`. Their digests go through a :class:`MergeIndex`; entries with a
    count of one are done. Rows of the others (hits), found through the run's filter, are verified: they are grouped by
    digest and by the normalised text itself, pre-aggregated in every task, so that a group of any size shuffles one row a
    task. A hit with one text has its keep_id and size from the index; one with several has them from its texts.

    * null and empty texts are equal to each other; very long texts are compared whole; empty table: no rows;
    * null doc_id: never the row that stays, unless a group has no other (then keep_id is null and kept is true);
    * rows that repeat both doc_id and text are one document and share its decision; group_size counts rows;
    * other columns of the input are not read.
    """
    text = normalised(F.col("text"))
    log = materialize(docs.select("doc_id", F.xxhash64(text).alias("digest"), F.sha2(text.cast("binary"), 256).alias("text_sha256")), "digests")
    index = MergeIndex()
    index.flush(log)
    hits = materialize(index.entries().where("n > 1"), "hits")
    held = DigestFilter(hits)
    rows = looked_up(docs.select("doc_id", text.alias("norm")).withColumn("digest", F.xxhash64("norm")), hits, held, ["digest"])
    same = rows.groupBy("digest", "norm").agg(F.min("doc_id").alias("low"), F.count("*").alias("size"), F.first("min_id").alias("min_id"), F.first("n").alias("n"))
    one = F.col("size") == F.col("n")  # all rows of the entry have this text
    groups = same.select("digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when(one, F.col("min_id")).otherwise(F.col("low")).alias("keep"), "size")
    groups = materialize(groups, "verified")
    found = looked_up(log, groups, held, ["digest", "text_sha256"], "left")
    rest = log.where(~held.may_hold(F.col("digest"))).select("*", F.lit(None).cast("bigint").alias("keep"), F.lit(None).cast("bigint").alias("size"))
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep"))
    return found.unionByName(rest).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op3_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
