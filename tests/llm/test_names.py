"""Tables whose further columns have every name that the operators use inside: nothing crashes, clashes or gets lost."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocation, decontaminate, exact_dedup, html_text, language, line_dedup, lm_score, mixing, secrets, sharding, simhash, spelling, url_filter

SF = "/root/testdata/sf0.001"
CORPUS = Path(decontaminate.__file__).parent


def inner_names():
    """All words in quotes in the subpackage that could name a column."""
    found = set()
    for f in CORPUS.glob("*.py"):
        found |= set(re.findall(r"""["']([a-z_][a-z0-9_]{0,15})["']""", f.read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "item_id"})


def widened(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in inner_names()])


DOCS = {
    "decontamination": lambda s, d: decontaminate.without_benchmark(d, s.read.parquet(f"{SF}/benchmark.parquet")),
    "leaks": lambda s, d: decontaminate.contaminated(d, widened(s.read.parquet(f"{SF}/benchmark.parquet"))),
    "exact": lambda s, d: exact_dedup.dedup_groups(d),
    "near": lambda s, d: simhash.drop_near_duplicates(d),
    "components": lambda s, d: simhash.simhash_components(d),
    "language": lambda s, d: language.keep_known_languages(d),
    "secrets": lambda s, d: secrets.scan(d),
    "scores": lambda s, d: lm_score.score_documents(d),
    "mixing": lambda s, d: mixing.mix(d),
    "shards": lambda s, d: sharding.with_shards(d, 4),
    "lines": lambda s, d: line_dedup.without_repeated_lines(d),
    "spelling": lambda s, d: spelling.spelling_variants(d),
    "phrases": lambda s, d: collocation.collocations(d, fewest=5),
}


@pytest.mark.parametrize("name", DOCS)
def test_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = DOCS[name](spark, widened(docs))
    if name in ("near", "components", "scores"):  # many jobs: the other tests have their rows
        assert 0 < wide.count() <= 40 and (name != "near" or wide.columns == widened(docs).columns)
        return
    plain = DOCS[name](spark, docs)
    assert plain.count() == wide.count()
    if not {"leaks", "exact", "spelling", "phrases"} & {name}:
        new = set(plain.columns) - set(docs.columns)
        kept = [n for n in inner_names() if n not in new]
        assert set(kept) <= set(wide.columns)
        first = wide.select(kept).first()
        assert first is None or all(first[n] == f"own {n}" for n in kept)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host = url_filter.host_of(F.col("url"))
    model = url_filter.fit_url_model(pages, url_filter.named(host, ("a",)), terms=("a",))
    for plain, wide in ((url_filter.judge_urls(pages, model), url_filter.judge_urls(widened(pages), model)), (html_text.extract(pages), html_text.extract(widened(pages)))):
        both = [c for c in plain.columns if c != "html"]
        assert sorted(map(str, plain.select(both).collect())) == sorted(map(str, wide.select(both).collect()))
