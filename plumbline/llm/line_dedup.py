"""Line dedup: hashed lines in ranges, sorted by document and position, dropped as bitmaps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize, parts

#: What is stripped from both ends of a line, and the fewest code points of a key.
BLANK, LEAST = " \t\n\x0b\x0c\r", 10
#: Sampled lines for each range, and how many of them a key must have to be split. They decide the balance, never a result.
SAMPLED, HOT = 64, 8
#: The order key of null ids: in front of all others.
FIRST = -(1 << 63)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def _order(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(FIRST))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(o, th, pos, h, g): order key and text hash of the document, position of the line, 128 bits of the line's key."""
    d = docs.select(_order(id_col).alias("o"), _text_hash(text_col).alias("th"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    d = d.where(F.length("line") >= least).select("o", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return d.select("o", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def _hot_keys(lines: DataFrame, ranges: int) -> DataFrame:
    """(h, g, m, known): keys that a sample shows to fill much of a range, the number of pieces for each, its first document.

    The sample has SAMPLED lines a range, so there are ``ranges * SAMPLED / HOT`` such keys at most.
    """
    total, want = lines.count(), ranges * SAMPLED
    sample = lines.select("h", "g") if total <= want else lines.select("h", "g").sample(min(1.0, want / total), seed=29)
    found = sample.limit(2 * want).groupBy("h", "g").count().where(F.col("count") >= HOT)
    pieces = [(r.h, r.g, -(-2 * r["count"] // HOT)) for r in found.collect()]
    hot = F.broadcast(lines.sparkSession.createDataFrame(pieces, "h long, g long, m int"))
    return F.broadcast(lines.join(hot, ["h", "g"]).groupBy("h", "g", "m").agg(F.min("o").alias("known")))


def repeated_lines(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(o, th, pos) of the lines whose key a document of a smaller order key holds.

    Keys are dealt to ranges of their hash; in a range, the lines of a key are sorted by document and position, and the first
    one streams past the rest. A key that would fill a range by itself is cut into pieces of their own, by document and
    block of positions; its first document comes from one small aggregate.
    """
    ranges = ranges or parts(lines.sparkSession)
    piece = F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("o", "th", F.expr("pos div 4096")), F.col("m").cast("bigint"))).cast("int")
    d = lines.join(_hot_keys(lines, ranges), ["h", "g"], "left").select("o", "th", "pos", "h", "g", "known", piece.alias("piece"))
    inside = Window.partitionBy("h", "g", "piece").orderBy("o", "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.least(F.first("o").over(inside), F.col("known"))
    return d.repartitionByRange(ranges, "h", "g", "piece").withColumn("first", first).where("o > first").select("o", "th", "pos")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(o, th, keep, n_dropped) of the documents that lose lines: the result instead of their texts.

    ``o`` is the id (null: the smallest long), ``th`` the hash of the text, ``keep`` ascending entries (word, bits): bit i of
    word w says whether line 64 w + i stays; words that are not listed are all ones.
    """
    lines = materialize(hashed_lines(docs, id_col, text_col, least), "lines")
    words = repeated_lines(lines).groupBy("o", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("bits"))
    maps = words.groupBy("o", "th").agg(F.sort_array(F.collect_list(entry)).alias("keep"), F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"))
    out = materialize(maps, "keep")
    discard(lines)
    return out


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` whose bits are set, joined by a line feed."""

    def unfolded(entries: Column) -> Column:  # one long for each word up to the last entry
        gap = lambda e, j: e["word"] - F.coalesce(F.get(entries, j - 1)["word"], F.lit(-1)) - 1
        return F.flatten(F.transform(entries, lambda e, j: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), gap(e, j)), F.array(e["bits"]))))

    def joined(words: Column) -> Column:
        stays = lambda line, i: F.getbit(F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(-1).cast("bigint")), i % 64) == 1
        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    # what a lambda captures is bound once a row by a transform over one element
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return F.when(keep.isNull(), text).otherwise(once(keep, lambda k: once(unfolded(k), joined)))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``kept`` (the text without repeated lines), ``keep`` (its bitmap, null: all), ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Of a key of ``least`` code points that several
    documents hold, only the lines in the document with the smallest id stay, all of them; shorter keys always stay.

    * null or empty text: one empty line, which stays; empty table: no rows;
    * null ids are one document in front of all others; rows that share an id are one document;
    * rows repeated in full have one bitmap; a very long text has one entry of 12 bytes for 64 lines with a dropped one;
    * columns of the input are carried in a struct, so their names never clash; ``kept``, ``keep``, ``n_lines`` and
      ``n_dropped`` of the input are replaced.
    """
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, least=least)
    own = [c for c in docs.columns if c not in ("kept", "keep", "n_lines", "n_dropped")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), _order(id_col).alias("o"), _text_hash(text_col).alias("th"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    d = d.join(maps, ["o", "th"], "left")
    return d.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in own],
        kept_text(F.col("_text"), F.col("keep")).alias("kept"),
        "keep",
        F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
               FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
                     FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
     firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
     judged AS (SELECT l.doc_id, l.line, l.pos, f.first IS NOT NULL AND l.doc_id > f.first AS gone FROM lines l LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
