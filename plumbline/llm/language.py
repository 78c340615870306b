"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fold, materialize, text_batches

#: Length of the vectors, letters of an n-gram, letter classes (0 is whatever parts words; rare letters share classes).
DIM, GRAM, LETTERS = 1024, 3, 512
UNKNOWN = "und"
#: The pipeline's stage rejects a document whose cosine is under the bar of its length. Lengths are classes of n-grams by
#: powers of two. A bar is the QUANTILE of the labelled rows' own scores in the class less NOISE, the deviation of the
#: cosine of unrelated vectors, and never under REJECT_BELOW. A class with fewer labelled rows than LEAST takes the quantile
#: of the next longer class times the root of 1/2 (few n-grams' cosines grow with the root of their number, more grow
#: slower), or that of the next shorter one if no longer class has as many.
REJECT_BELOW, QUANTILE, NOISE, LEAST = 0.01, 0.001, DIM**-0.5, 20
#: Documents that share one matrix product.
BLOCK = 64
#: N-gram codes whose vectors are made at a time.
CODES = 2048
#: Languages that a model can hold; the prototypes are DIM numbers each, so this bounds what is sent to executors.
MAX_LANGUAGES = 1000


def letter_class(point: int) -> int:
    """0 for a code point that is no letter, a class of its own for a to z in either case, a shared one for other letters."""
    c = chr(point)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 95 if 97 <= low <= 122 else 28 + low % (LETTERS - 28)


def _tables(seed: int = 20) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class of each code point of two bytes, and the letter vectors rotated by 2, 1 and 0."""
    classes = np.array([letter_class(cp) for cp in range(1 << 16)], np.int64)
    rng = np.random.default_rng(seed)
    letters = rng.choice(np.array([-1, 1], np.int8), size=(LETTERS, DIM))
    return classes, [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]


class Encoder:
    """Texts to n-gram codes and n-gram codes to bound vectors."""

    def __init__(self) -> None:
        self.classes, self.letters = _tables()

    def grams(self, text: str | None) -> np.ndarray:
        """Codes of all letter n-grams of a whole text, where runs of other characters count as one space."""
        if not text:
            return np.zeros(0, np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = self.classes[np.minimum(points, (1 << 16) - 1)]
        rare = np.flatnonzero(points >= 1 << 16)
        if len(rare):
            kinds, at = np.unique(points[rare], return_inverse=True)
            c[rare] = np.array([letter_class(int(p)) for p in kinds])[at]
        if not c.any():
            return np.zeros(0, np.int64)
        c = np.concatenate([[0], c, [0]])
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        code = c[: len(c) - GRAM + 1].copy()
        for k in range(1, GRAM):
            code = code * LETTERS + c[k : len(c) - GRAM + 1 + k]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vector of each code: the elementwise product of its letters' rotated vectors."""
        out = self.letters[GRAM - 1][codes % LETTERS]
        for k in range(GRAM - 2, -1, -1):
            codes = codes // LETTERS
            out = out * self.letters[k][codes % LETTERS]
        return out

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, DIM): the sum of all n-gram vectors of each text; and each text's number of n-grams."""
        out, sizes = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), BLOCK):
            per = [np.unique(self.grams(t), return_counts=True) for t in texts[at : at + BLOCK]]
            codes, where = np.unique(np.concatenate([c for c, _ in per]), return_inverse=True)
            rows = np.repeat(np.arange(len(per)), [len(c) for c, _ in per])
            counts = np.concatenate([n for _, n in per])
            sizes[at : at + len(per)] = [n.sum() for _, n in per]
            for lo in range(0, len(codes), CODES):
                inside = (where >= lo) & (where < lo + CODES)
                width = min(CODES, len(codes) - lo)
                dense = np.zeros((len(per), width), np.float32)
                dense[rows[inside], where[inside] - lo] = counts[inside]
                out[at : at + len(per)] += dense @ self.vectors(codes[lo : lo + width]).astype(np.float32)
        return out, sizes


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a language and task: n-gram counts first, their vectors once at the end."""
    enc = Encoder()
    held: dict[str, dict[str, np.ndarray]] = {}
    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            for at in range(0, len(texts), BLOCK):
                codes, n = np.unique(np.concatenate([enc.grams(t) for t in texts.iloc[at : at + BLOCK]]), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang]["codes"], codes])
                    codes, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([held[lang]["n"], n]))
                held[lang] = {"codes": codes, "n": n}
    rows = []
    for lang, h in held.items():
        total = np.zeros(DIM)
        for lo in range(0, len(h["codes"]), CODES):
            total += h["n"][lo : lo + CODES].astype(np.float64) @ enc.vectors(h["codes"][lo : lo + CODES])
        rows.append((lang, total.tolist()))
    yield pd.DataFrame(rows, columns=["lang", "bundle"])


def fit_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from the columns text and lang of all given rows.

    Every task bundles its rows; the bundles (DIM numbers a language and task) are summed by language and dimension.
    """
    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(_summed, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    with text_batches(docs.sparkSession):
        rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {r.lang: np.array([e.x for e in r.v]) for r in rows}
    found = {k: v for k, v in found.items() if v.any()}
    names = sorted(found)
    protos = np.array([found[k] / np.linalg.norm(found[k]) for k in names]).reshape(len(names), DIM)
    return names, protos.astype(np.float32)


def with_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, sizes: str | None = None) -> DataFrame:
    """``docs`` plus lang_pred (the prototype of the largest cosine; ties: the first name) and score (that cosine, 0 to 1).

    * null text, or no letter in it: ``und``, score 0; so has every row if nothing was learned;
    * very long texts are read whole; repeated rows get equal rows; empty table: no rows;
    * columns of the input named ``lang_pred`` or ``score`` are replaced, others are carried in a struct. None but ``text``
      is an input; ``sizes`` names a further column for the number of n-grams.
    """

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = Encoder()
        for texts in batches:
            b, n = enc.bundles(list(texts))
            norm = np.linalg.norm(b, axis=1)
            known = norm > 0 if len(names) else np.zeros(len(b), bool)
            cos = np.zeros((len(b), max(1, len(names))), np.float32)
            if len(names):
                cos[known] = b[known] @ prototypes.T / norm[known, None]
            best = cos.argmax(1)
            lang = [names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            score = np.where(known, np.clip(cos[np.arange(len(b)), best], 0, 1), 0.0).astype(np.float64)
            yield pd.DataFrame({"lang_pred": lang, "score": np.round(score, 6), "n": n})

    own = [c for c in docs.columns if c not in ("lang_pred", "score", sizes)]
    udf = pandas_udf(predicted, "lang_pred string, score double, n bigint")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), udf("text").alias("said"))
    more = [F.col("said.n").alias(sizes)] if sizes else []
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("said.lang_pred").alias("lang_pred"), F.col("said.score").alias("score"), *more)


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(fold(F.col("doc_id")), F.lit(3)) == 1
    names, protos = fit_prototypes(docs.where(~held))
    return with_language(docs.select("doc_id", held.alias("held_out"), "text"), names, protos).select("doc_id", "held_out", "lang_pred", "score")


def fit_bars(scored: DataFrame) -> list[float]:
    """Bar of each length class 0 to 63, from the score and length class (``size``) of the labelled rows."""
    rows = scored.groupBy("size").agg(F.percentile_approx("score", QUANTILE, 10_000).alias("low"), F.count("*").alias("n")).collect()
    low = {r["size"]: r.low for r in rows if r.n >= LEAST}
    for size in range(max(low, default=0) - 1, -1, -1):
        low.setdefault(size, low[size + 1] * 0.5**0.5)
    for size in range(1, 64):
        low.setdefault(size, low.get(size - 1, 0.0))
    return [max(REJECT_BELOW, low.get(size, 0.0) - NOISE) for size in range(64)]


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: learn from the labelled rows, drop rows without letters or unlike every language.

    Unlike is a score under the bar of the row's length (see :func:`fit_bars`). Texts of a few n-grams have scores so
    near to noise that their bar lets most of anything pass; so it is if hardly any row is labelled.

    * null or empty text, or no letter in it: dropped; so is every row if no row is labelled;
    * a label never saves a row: labelled ones that are unlike every language go too (one in a thousand, see QUANTILE);
    * very long texts are read whole; repeated rows share their fate; empty table: no rows;
    * columns are carried in a struct, so their names never clash, and stay as they are.
    """
    names, protos = fit_prototypes(docs)
    own = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("lang").isNotNull().alias("labelled"), "text")
    marked = materialize(with_language(given, names, protos, "n").where(F.col("lang_pred") != UNKNOWN).drop("text").withColumn("size", F.floor(F.log2("n")).cast("int")), "languages", texts=True)
    bars = fit_bars(marked.where("labelled"))
    kept = marked.where(F.col("score") >= F.element_at(F.array(*[F.lit(x) for x in bars]), F.col("size") + 1))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in own])
