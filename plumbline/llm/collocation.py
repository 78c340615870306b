"""Phrase collocations by contiguous pattern growth: right contexts of frequent prefixes, extended depth-first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts, small, text_batches

#: Fewest occurrences of a candidate, most words, phrases a language, share of a longer phrase in percent.
FEWEST, LONGEST, FIRST, CONTAINED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Counters for the phrases of one length: a power of two for a few words each, MOST_BITS at most. Which of them reach the bar
#: is broadcast as bits, 64 MB at most; with more phrases than counters fewer contexts are cut short, and the result is the same.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 29, 16
#: Distinct words, and distinct counters, that a task gathers before it hands them on.
HELD_WORDS, HELD_COUNTERS = 400_000, 4_000_000
#: Characters of text that a task splits at a time, unless one text has more.
BYTES = 4_000_000
#: A-Z are lower-cased, piece borders become line feeds, tabs become spaces.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, words, border): the texts' words in order with borders between pieces and texts; ``words[codes]`` are the words."""
    flat = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass")
    found = ["\n", *filter(None, flat.replace("\n", " \n ").split(" ")), "\n"]
    codes, words = pd.factorize(np.array(found, object))
    return codes, words, 0


def _by_language(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) in slices of about BYTES characters."""
    for f in frames:
        for lang, g in f.groupby("lang", sort=False):
            texts, size = [], 0
            for text in g["text"]:
                texts.append(text)
                size += len(text)
                if size >= BYTES:
                    yield lang, texts
                    texts, size = [], 0
            if texts:
                yield lang, texts


def _mixed(lang: str, words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words) ^ np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))


class _Phrases:
    """Hashes of the phrases that begin at each place of a text, and which of them may be frequent."""

    def __init__(self, lang: str, texts: list[str], bits: int) -> None:
        self.codes, self.words, self.border = _tokens(texts)
        self.each, self.inside, self.shift = _mixed(lang, self.words)[self.codes], self.codes != self.border, np.uint64(64 - bits)
        self.hash, self.may = [self.each], [self.inside]

    def longer(self, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, counters) of the phrases of one word more whose both shorter parts may be frequent.

        With ``frequent``, the bits of these counters, only those whose counter reaches the bar stay for the next length.
        """
        n = len(self.hash)
        size = len(self.codes) - n
        ok = self.may[-1][:size] & self.may[-1][1 : size + 1]
        h = self.hash[-1][:size] * np.uint64(0x9E3779B97F4A7C15) + self.each[n : n + size]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        at = np.flatnonzero(ok)
        slots = (h[at] >> self.shift).astype(np.int64)
        if frequent is not None:
            keep = (frequent[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
            ok = np.zeros(size, bool)
            ok[at[keep]] = True
        self.hash.append(h)
        self.may.append(ok)
        return at, slots


class _Tally:
    """Counters of one length that a task has raised: gathered, then given out by blocks, saturated at the bar.

    Saturated parts keep every sum at or above the bar there.
    """

    def __init__(self, size: int, fewest: int) -> None:
        self.size, self.fewest, self.parts, self.held = size, min(fewest, 255), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.parts.append(np.unique(slots, return_counts=True))
        self.held += len(self.parts[-1][0])

    def rows(self) -> Iterator[pd.DataFrame]:
        if not self.held:
            return
        slots, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        slots, counts = slots[first], np.minimum(np.add.reduceat(counts, first), self.fewest).astype(np.uint8)
        block = slots >> BLOCK_BITS
        begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        packed = []
        for lo, hi in zip(begins, np.r_[begins[1:], len(block)]):
            place = (slots[lo:hi] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            packed.append(zlib.compress(np.diff(place, prepend=np.uint16(0)).tobytes() + counts[lo:hi].tobytes(), 1))
        self.parts, self.held = [], 0
        yield pd.DataFrame({"lang": None, "word": None, "n": 0, "size": self.size, "block": block[begins], "bits": packed})


_COUNTED = "lang string, word string, n long, size int, block int, bits binary"


def _word_rows(words: dict[str, dict[str, int]]) -> Iterator[pd.DataFrame]:
    for lang, n in words.items():
        yield pd.DataFrame({"lang": lang, "word": pd.Series(list(n), dtype=object), "n": list(n.values()), "size": 1, "block": -1, "bits": None})
    words.clear()


def _counted(bits: int, sizes: tuple[int, ...], known, fewest: int):
    """Tallies of the phrases of ``sizes`` words, whose shorter ones are in ``known``; with pairs also all words and their counts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = {n: _Tally(n, fewest) for n in sizes}
        words: dict[str, dict[str, int]] = {}
        for lang, texts in _by_language(frames):
            p = _Phrases(lang, texts, bits)
            if 2 in sizes:
                own, n = words.setdefault(lang, {}), np.bincount(p.codes, minlength=len(p.words))
                n[p.border] = 0
                for word, c in zip(p.words[n > 0].tolist(), n[n > 0].tolist()):
                    own[word] = own.get(word, 0) + c
                if sum(map(len, words.values())) > HELD_WORDS:
                    yield from _word_rows(words)
            for size in range(2, max(sizes) + 1):
                slots = p.longer(np.frombuffer(known.value[size], np.uint8) if size < min(sizes) else None)[1]
                if size in tallies:
                    tallies[size].add(slots)
            if sum(t.held for t in tallies.values()) > HELD_COUNTERS:
                for t in tallies.values():
                    yield from t.rows()
        yield from _word_rows(words)
        for t in tallies.values():
            yield from t.rows()

    return work


def _frequent(fewest: int):
    """Adds up the counters of a block as they stream by, sorted by length and block: bits of those that reach the bar."""

    def done(key: tuple[int, int], total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"size": [key[0]], "block": [key[1]], "bits": [np.packbits(total >= min(fewest, 255)).tobytes()]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for f in frames:
            for size, block, bits in zip(f["size"], f["block"], f["bits"]):
                if (size, block) != key:
                    if key is not None:
                        yield done(key, total)
                    key, total = (size, block), np.zeros(1 << BLOCK_BITS, np.int64)
                raw = zlib.decompress(bits)
                n = len(raw) // 3
                total[np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.uint16)] += np.frombuffer(raw, np.uint8, n, 2 * n)
        if key is not None:
            yield done(key, total)

    return work


def _reached(counted: DataFrame, bits: int, sizes: tuple[int, ...], fewest: int) -> dict[int, bytes]:
    """The bits of each length's counters, 2^MOST_BITS of them at most."""
    blocks = counted.where("block >= 0").select("size", "block", "bits").repartition("size", "block").sortWithinPartitions("size", "block")
    out = {n: np.zeros(1 << (bits - 3), np.uint8) for n in sizes}
    wide = 1 << (BLOCK_BITS - 3)
    for r in blocks.mapInPandas(_frequent(fewest), "size int, block int, bits binary").toLocalIterator():
        out[r["size"]][r.block * wide : (r.block + 1) * wide] = np.frombuffer(r.bits, np.uint8)
    return {n: b.tobytes() for n, b in out.items()}


def _contexts(bits: int, known, longest: int):
    """(lang, w1 .. wk, c): each word with those after it, as far as the phrase that they make may be frequent."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, texts in _by_language(frames):
            p = _Phrases(lang, texts, bits)
            for size in range(2, longest + 1):
                p.longer(np.frombuffer(known.value[size], np.uint8))
            at = np.flatnonzero(p.may[1])
            if not len(at):
                continue
            many, group, table = len(p.words), np.zeros(len(at), np.int64), []
            for k in range(longest):  # equal contexts get one number, a word more at a time
                has = p.may[k][np.minimum(at, len(p.may[k]) - 1)] & (at < len(p.may[k]))
                word = np.where(has, p.codes[np.minimum(at + k, len(p.codes) - 1)], p.border)
                table.append(word)
                group = np.unique(group * many + word, return_inverse=True)[1]
            _, first, c = np.unique(group, return_index=True, return_counts=True)
            names = p.words.astype(object)
            names[p.border] = None
            yield pd.DataFrame({"lang": lang} | {f"w{k + 1}": names[word[first]] for k, word in enumerate(table)} | {"c": c})

    return work


def grown(frames: Iterator[pd.DataFrame], fewest: int, longest: int) -> Iterator[pd.DataFrame]:
    """Pattern growth over contexts that come sorted: (lang, phrase, words, f).

    A prefix is projected to the run of contexts that begin with it, kept as two pointers; it is extended to the right,
    depth-first, by the runs inside. Runs below ``fewest`` end there, unless they touch a border of the batch: these may go on
    in the next batch or task, and their counts are added up afterwards.
    """
    columns = ["lang", *[f"w{k + 1}" for k in range(longest)]]
    for f in frames:
        if not len(f):
            continue
        values = [f[x].to_numpy(object) for x in columns]
        c, size = np.r_[0, np.cumsum(f["c"].to_numpy(np.int64))], len(f)
        fresh, begins = np.zeros(size, bool), []
        for v in values:
            code = pd.factorize(v)[0]  # -1 for a missing word
            fresh = fresh | np.r_[True, code[1:] != code[:-1]]
            begins.append(np.r_[np.flatnonzero(fresh), size])
        out = []

        def extend(depth: int, low: int, high: int, prefix: str | None) -> None:
            edges = begins[depth]
            for k in range(int(np.searchsorted(edges, low)), int(np.searchsorted(edges, high))):
                lo, hi = int(edges[k]), int(edges[k + 1])
                n, word = int(c[hi] - c[lo]), values[depth][lo]
                if word is None or (n < fewest and lo and hi < size):
                    continue
                phrase = word if prefix is None else f"{prefix} {word}"
                if depth > 1:
                    out.append((values[0][lo], phrase, depth, n))
                if depth < longest:
                    extend(depth + 1, lo, hi, phrase)

        for lo, hi in zip(begins[0][:-1], begins[0][1:]):
            extend(1, int(lo), int(hi), None)
        yield pd.DataFrame(out, columns=["lang", "phrase", "words", "f"])


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", fewest: int = FEWEST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, phrase, f) of all words, and (lang, phrase, words, f) of all phrases with f >= ``fewest``, exact.

    A first pass counts words, and pairs in a bounded table of counters; a second one longer phrases in the same way. A phrase
    whose counter stays below ``fewest`` is rarer than that, and so is any phrase with it inside. The third pass projects each
    word to the right contexts that are left; equal contexts are added up before they are dealt to ranges, so that a prefix of
    any share of the rows is spread by what follows it.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.length("text") > 0)
    size = d.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first().n or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // 16).bit_length()))
    first = materialize(d.mapInPandas(_counted(bits, (2,), None, fewest), _COUNTED), "words", texts=True)
    words = materialize(first.where("size = 1").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    reached = _reached(first, bits, (2,), fewest)
    discard(first)
    if longest > 2:
        pairs, more = spark.sparkContext.broadcast(dict(reached)), tuple(range(3, longest + 1))
        second = materialize(d.mapInPandas(_counted(bits, more, pairs, fewest), _COUNTED), "longer", texts=True)
        reached |= _reached(second, bits, more, fewest)
        discard(second)
        pairs.unpersist()
    names = [f"w{k + 1}" for k in range(longest)]
    cut = d.mapInPandas(_contexts(bits, spark.sparkContext.broadcast(reached), longest), "lang string, " + ", ".join(f"{x} string" for x in names) + ", c long")
    with text_batches(spark):
        contexts = materialize(cut.groupBy("lang", *names).agg(F.sum("c").alias("c")), "contexts")
    dealt = contexts.repartitionByRange(parts(spark), "lang", *names).sortWithinPartitions("lang", *names)
    runs = dealt.mapInPandas(lambda frames: grown(frames, fewest, longest), "lang string, phrase string, words int, f long")
    phrases = materialize(runs.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= fewest), "phrases")
    discard(contexts)
    return words, phrases


def _joined(words: Column, first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def scored(words: DataFrame, phrases: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): the lowest-scoring cut of each phrase, ties to the smallest k."""
    known = words.where(F.col("f") >= fewest).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    d = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    d = d.select("lang", "phrase", "words", "a", "k", _joined(F.col("ws"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("ws"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    d = d.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    d = d.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # the product may pass 64 bits, the quotient of it by l + r >= 2 a can't
    d = d.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(8, 0))) div CAST(l + r AS DECIMAL(20, 0))"))
    low = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return d.groupBy("lang", "phrase", "words", "a").agg(low.alias("cut")).select("lang", "phrase", "words", "a", "cut.*")


def without_contained(candidates: DataFrame, phrases: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """Candidates that no longer phrase of ``contained`` percent of their occurrences has inside."""
    d = phrases.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("ws"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    d = d.select("lang", "ws", "f", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = d.select("lang", _joined(F.col("ws"), F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    share = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n)
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (share("longer", 100) < share("a", contained))).drop("longer")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", fewest: int = FEWEST, first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of 2 to 4 words of each language by score: (lang, rank, phrase, a, l, r, n, score).

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of both sides of its lowest-scoring cut, ``n`` all words of the
    language. Ties go to the larger ``a``, then to the smaller phrase in bytes, so ranks are the same on every partitioning.

    * null language: ``und``, together with a language of that name; null or empty text: no words;
    * empty table, or nothing frequent: no rows; repeated rows count each time;
    * a very long text is split in one task, whole; any other columns are left out, so their names can't clash.
    """
    words, phrases = phrase_counts(docs, lang_col=lang_col, text_col=text_col, fewest=fewest)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    d = without_contained(scored(words, phrases, fewest), phrases)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(16))  # a language of most phrases is cut to its first ones in parts
    part = d.withColumn("salt", salt).withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= first)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    out = ranked.join(small(totals), "lang")
    return out.select("lang", *[F.col(c).cast("bigint").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, string_split(replace(p, chr(9), ' '), ' ') AS ws
                FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13),
                      'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9)), chr(10))) AS p FROM documents)),
     clean AS (SELECT lang, list_filter(ws, lambda x: x <> '') AS ws FROM pieces),
     sized AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM clean),
     grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
               FROM sized, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
     f AS (SELECT lang, k AS size, phrase, count(*) AS f FROM grams GROUP BY ALL),
     total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
     c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
     cuts AS (SELECT c.*, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 :], ' ') AS rp
              FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
     valued AS (SELECT cuts.*, fl.f AS l, fr.f AS r, CAST((2000000::HUGEINT * a) // (fl.f + fr.f) AS BIGINT) AS score
                FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp AND fl.size = k
                          JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp AND fr.size = cuts.size - k),
     best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size
              AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
