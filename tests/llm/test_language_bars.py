"""The pipeline's language stage on planted gibberish, unlearned languages and short clean texts."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import language

FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских. ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on "
    "toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin. ",
]


def test_gibberish_and_unlearned_languages_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    junk = ["".join(" " if rng.random() < 0.16 else chr(97 + int(rng.integers(26))) for _ in range(n)) for n in (500, 1000, 2000, 8000) for _ in range(5)]
    junk += [t * k for t in FOREIGN for k in (2, 4, 8)]
    clean = [" ".join(r.text.split()[:n]) for r in docs.where("lang = 'en' AND length(text) > 2000").orderBy("doc_id").limit(5).collect() for n in (60, 120)] + ["the end of the day"]
    planted = [(-1000 - i, t, None) for i, t in enumerate(junk)] + [(-1 - i, t, None) for i, t in enumerate(clean)]
    kept = language.keep_known_languages(docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, lang string")))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [i for i in ids if i <= -1000]
    assert {-1 - i for i in range(len(clean))} <= ids
    labelled = {r.doc_id for r in docs.where(F.col("lang").isNotNull()).collect()}
    assert len(labelled - ids) <= 0.003 * len(labelled)
