"""URL filtering: host and path rules, then a ratio of two character language models."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import lower_ascii

#: (verdict, rule): a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Weak labels for the models: a host that holds one of these terms counts as rejected, any other as accepted. The models
#: never see a term, neither when they learn nor when they score (see :func:`model_text`), so what they learn is what else
#: such URLs have in common.
REJECTED_TERMS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: Bound of the labelled sample, a side; one URL in five of it is held out and calibrates the threshold.
SAMPLE_ROWS, HELD = 20_000, 5
ORDER = 5
_BEGIN, _END = 2, 3


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is the outermost test
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------- the two models


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all URLs (each with an end), their contexts packed by order, and the URL of each symbol."""
    pad = bytes([_BEGIN]) * ORDER
    data = np.frombuffer(b"".join(pad + u + bytes([_END]) for u in urls), np.uint8).astype(np.uint64)
    lens = np.array([len(u) + 1 for u in urls], np.int64)
    owner = np.repeat(np.arange(len(urls)), lens)
    starts = np.cumsum(lens + ORDER) - lens
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
    contexts = np.zeros((ORDER + 1, len(at)), np.uint64)
    for k in range(1, ORDER + 1):
        contexts[k] = contexts[k - 1] | data[at - k] << np.uint64(8 * (k - 1))
    for k in range(1, ORDER + 1):
        contexts[k] |= np.uint64(k) << np.uint64(8 * ORDER)
    return data[at], contexts, owner


@dataclass
class MarkovModel:
    """Counts of a variable-order Markov model, as sorted arrays; Witten-Bell smoothing backs off to 1/256."""

    grams: np.ndarray
    gram_n: np.ndarray
    contexts: np.ndarray
    context_n: np.ndarray
    context_types: np.ndarray

    @classmethod
    def fit(cls, urls: list[bytes]) -> MarkovModel:
        symbol, contexts, _ = _grams(urls)
        grams, n = np.unique((contexts | symbol[None, :] << np.uint64(48)).ravel(), return_counts=True)
        ctx = grams & np.uint64((1 << 48) - 1)
        keys, inverse = np.unique(ctx, return_inverse=True)
        return cls(grams, n.astype(np.float64), keys, np.bincount(inverse, n), np.bincount(inverse).astype(np.float64))

    def log_prob(self, symbol: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        p = np.full(len(symbol), 1 / 256)
        for k in range(ORDER + 1):
            c = _found(self.grams, self.gram_n, contexts[k] | symbol << np.uint64(48))
            n = _found(self.contexts, self.context_n, contexts[k])
            t = _found(self.contexts, self.context_types, contexts[k])
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class UrlModel:
    """Accepted and rejected models, the threshold on their log-likelihood difference a symbol, and the shares of held-out
    accepted URLs below it and of held-out rejected URLs not below it."""

    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float = 0.0
    false_rejects: float = 0.0
    false_accepts: float = 0.0

    def score(self, urls: pd.Series) -> np.ndarray:
        out = np.zeros(len(urls))
        for at in range(0, len(urls), 4096):
            some = [(u or "").encode() for u in urls.iloc[at : at + 4096]]
            symbol, contexts, owner = _grams(some)
            diff = self.accepted.log_prob(symbol, contexts) - self.rejected.log_prob(symbol, contexts)
            out[at : at + len(some)] = np.bincount(owner, diff, len(some)) / np.bincount(owner, minlength=len(some))
        return out


def named(host: Column, terms=REJECTED_TERMS) -> Column:
    """Whether a host holds one of the terms that label URLs as rejected."""
    return host.rlike("|".join(map(re.escape, terms))) if terms else F.lit(False)


def model_text(url: Column, terms=REJECTED_TERMS) -> Column:
    """What the models read: the URL from the host on, without the terms and the hyphens beside them, which would tell that a term
    stood there; URLs without a host give an empty text."""
    text = F.coalesce(F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)), F.lit(""))
    return F.regexp_replace(text, "(?i)-?(?:" + "|".join(map(re.escape, terms)) + ")-?", "") if terms else text


def calibrated(good: np.ndarray, bad: np.ndarray) -> tuple[float, float, float]:
    """(threshold, false rejects, false accepts) with the smallest sum of both error shares; in the middle of a tie."""
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.r_[cuts, np.inf] if len(cuts) else np.zeros(1)
    rejects = np.searchsorted(np.sort(good), cuts) / max(1, len(good))
    accepts = 1 - np.searchsorted(np.sort(bad), cuts) / max(1, len(bad))
    at = np.flatnonzero(np.isclose(rejects + accepts, (rejects + accepts).min()))
    k = at[len(at) // 2]
    below = cuts[k - 1] if k else cuts[k]
    threshold = below if np.isinf(cuts[k]) else (below + cuts[k]) / 2
    return float(np.nextafter(threshold, np.inf) if np.isinf(cuts[k]) else threshold), float(rejects[k]), float(accepts[k])


def fit_url_model(urls: DataFrame, rejected: Column, *, terms=REJECTED_TERMS, sample_rows: int = SAMPLE_ROWS) -> UrlModel | None:
    """Fit on ``sample_rows`` URLs a side at most, those with the smallest hashes; None if a side has none.

    One in HELD of each side is not learned from; the threshold is the one of the smallest sum of both sides' error
    shares on these (on all of a side that has fewer than HELD). ``rejected`` labels the rows of ``urls`` (column url).
    """
    rows = urls.select(model_text(F.col("url"), terms).alias("u"), F.coalesce(rejected, F.lit(False)).alias("bad")).where("u <> ''").distinct()
    sides = []
    for bad in (False, True):
        got = rows.where(F.col("bad") == bad).orderBy(F.xxhash64("u"), "u").limit(sample_rows).collect()
        sides.append([r.u for r in got])
    if not all(sides):
        return None
    learned = [[u.encode() for i, u in enumerate(s) if i % HELD or len(s) < HELD] for s in sides]
    model = UrlModel(*[MarkovModel.fit(s) for s in learned])
    held = [model.score(pd.Series(s[::HELD] if len(s) >= HELD else s)) for s in sides]
    model.threshold, model.false_rejects, model.false_accepts = calibrated(*held)
    return model


def errors_by_host(urls: DataFrame, rejected: Column, *, folds: int = 6, terms=REJECTED_TERMS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(host, bad, n, wrong): how many of a host's URLs the models judge wrong if they learn from other hosts only.

    Hosts are dealt to ``folds`` by hash; each fold is judged by models of the others. A fold without examples of one side to learn
    from is left out. This says how far labels by host carry over to hosts that were never seen, which held-out URLs of known
    hosts don't.
    """
    rows = urls.select("url", host_of(F.col("url")).alias("host"), F.coalesce(rejected, F.lit(False)).alias("bad")).where("host <> ''")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    out = None
    for k in range(folds):
        model = fit_url_model(rows.where(F.col("fold") != k), F.col("bad"), terms=terms, sample_rows=sample_rows)
        if model is None:
            continue
        judged = judge_urls(rows.where(F.col("fold") == k).select("url", "bad"), model, (), terms=terms)
        wrong = F.sum((F.col("bad") != (F.col("verdict") == "block")).cast("bigint"))
        part = judged.groupBy("host", "bad").agg(F.count("*").alias("n"), wrong.alias("wrong"))
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], "host string, bad boolean, n long, wrong long") if out is None else out


def judge_urls(pages: DataFrame, model: UrlModel | None, rules=RULES, *, terms=REJECTED_TERMS) -> DataFrame:
    """``pages`` plus host, path, rule, score (log-likelihood difference a symbol, accepted minus rejected), verdict.

    The verdict is the longest fitting rule's, else the models': block if the score is below the threshold.

    * null url or one without ``://``: empty host and path, no rule, score 0, allow (there is no evidence against it);
    * very long URLs are scored whole; repeated rows get equal rows; empty table: no rows;
    * without a model (no labelled examples of one side) every score is 0 and only rules block;
    * columns of the input with the names of the new ones are replaced, all others are carried in a struct.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), model_text(F.col("url"), terms).alias("text"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if model is None:
        score, threshold = F.lit(0.0), 0.0
    else:
        threshold = model.threshold

        @pandas_udf("double")
        def scored(u: pd.Series) -> pd.Series:
            return pd.Series(np.where(u == "", 0.0, model.score(u)))

        score = scored("text")
    d = d.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("score", score)
    learned = F.when((F.col("text") != "") & (F.col("score") < threshold), F.lit("block")).otherwise(F.lit("allow"))
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "host", "path", "rule", "score", F.coalesce("ruled", learned).alias("verdict"))


def op2_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = fit_url_model(pages, named(host_of(F.col("url"))))
    return judge_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
