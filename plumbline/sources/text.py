"""Text sources: line formats parsed with column expressions, so the scan splits files and nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import NEWSGROUPS, REUTERS_52, STOP_WORDS


def words(line: Column | str) -> Column:
    """Words between white space, without empty ones at the ends."""
    line = F.col(line) if isinstance(line, str) else line
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def without_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    stops = list(stop_words)  # a hashed set in the plan
    return F.array_join(F.filter(tokens, lambda w: ~w.isin(stops)) if stops else tokens, " ")


def collapsed(line: Column | str) -> Column:
    return F.array_join(words(line), " ")


def prefix_label(name: Column, classes: Sequence[str]) -> Column:
    """Position of the first class that ``name`` starts with; null if none does."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(classes))):
        out = F.when(name.startswith(c), i).otherwise(out)
    return out


def labelled_lines(df: DataFrame, line: str = "value", classes: Sequence[str] = NEWSGROUPS, *, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(name, label, text): the first two words name the class, the rest is the text without stop words.

    Lines whose name no class starts are left out, so labels never shift against texts.
    """
    tokens = words(line)
    name = F.array_join(F.slice(tokens, 1, 2), ".")
    text = without_stop_words(F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0))), stop_words)
    return df.select(name.alias("name"), prefix_label(name, classes).alias("label"), text.alias("text")).where("label IS NOT NULL")


def digit_lines(df: DataFrame, line: str = "value", *, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(label, text): non-word characters become spaces, the first character is the label; other lines are left out."""
    clean = F.trim(F.regexp_replace(F.col(line), r"(?U)\W+", " "))
    label = F.substring(clean, 1, 1).try_cast("int")
    return df.select(label.alias("label"), without_stop_words(words(F.substring(clean, 2, 1 << 30)), stop_words).alias("text")).where("label IS NOT NULL")


def unlabelled_lines(df: DataFrame, line: str = "value", *, label: int = -1) -> DataFrame:
    """(text, label): white space collapsed, one label for all; empty lines are left out."""
    return df.select(collapsed(line).alias("text"), F.lit(label).alias("label")).where("text <> ''")


def newsgroups(spark: SparkSession, path: str) -> DataFrame:
    return labelled_lines(spark.read.text(path), classes=NEWSGROUPS)


def reuters52(spark: SparkSession, path: str) -> DataFrame:
    return labelled_lines(spark.read.text(path), classes=REUTERS_52)


def reuters8(spark: SparkSession, path: str) -> DataFrame:
    return digit_lines(spark.read.text(path))


def multi30k(spark: SparkSession, path: str) -> DataFrame:
    return unlabelled_lines(spark.read.text(path))


def wmt16(spark: SparkSession, path: str) -> DataFrame:
    return unlabelled_lines(spark.read.text(path))


def wikitext(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    if split not in ("train", "test", "val"):
        raise ValueError("split must be train, test or val")
    return unlabelled_lines(spark.read.text(f"{root}/wiki.{'valid' if split == 'val' else split}.tokens"))
