"""Registered queries of sources, transforms, splits, benchmarks, queues and the scale test, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.labels import dense_labels
from ..operators import centers as C
from ..operators import classwise, detectors, metrics, splits
from ..sources import augment, files, text
from ..sources.fixed_values import STOP_WORDS
from .scoring import COLUMNS, _metric_sql, _rounded, gauss_distance, gauss_sql
from .setup import SQL, embeddings, setup, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def _register(name, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_WORDS = r"[w for w in regexp_split_to_array(text, '\s+') if w <> '']"
_register("text_whitespace", lambda s, d: table(s, d, "documents").select("doc_id", text.collapsed(F.coalesce("text", F.lit(""))).alias("text")), rf"SELECT doc_id, array_to_string({_WORDS.replace('(text,', "(coalesce(text, ''),")}, ' ') AS text FROM documents")
_register(
    "text_without_stop_words",
    lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.without_stop_words(text.words("text")).alias("text")),
    f"SELECT doc_id, array_to_string([w for w in {_WORDS} if NOT list_contains({_STOPS}, w)], ' ') AS text FROM documents WHERE text IS NOT NULL",
)


def _prefix(s, d):
    """Documents as lines that begin with two words of a class, the text without stop words after them."""
    lines = table(s, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat_ws(" ", "source", "lang", "doc_id", "text").alias("value"))
    return text.labelled_lines(lines, classes=["src1.", "src2.", "src3."])


_register("text_prefix_labels", _prefix, f"""SELECT source || '.' || lang AS name, CAST(CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END AS INTEGER) AS label,
array_to_string([w for w in {_WORDS.replace("(text,", "(doc_id || ' ' || coalesce(text, ''),")} if NOT list_contains({_STOPS}, w)], ' ') AS text
FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IS NOT NULL""")
_register(
    "text_digit_labels",
    lambda s, d: text.digit_lines(table(s, d, "conversations").select(F.concat(F.pmod("conv_id", F.lit(8)).cast("string"), F.lit("!  "), F.col("turn").cast("string"), F.lit("--the-"), "role").alias("value"))),
    "SELECT CAST(conv_id % 8 AS INTEGER) AS label, turn || ' ' || role AS text FROM conversations",
)
_register("source_inclusion_list", lambda s, d: files.including(table(s, d, "pages").select("page_id", F.col("url").alias("path")), table(s, d, "pages").where("page_id % 3 = 0").select(files.base_name("url").alias("name"))).select("page_id"), """
SELECT page_id FROM pages WHERE split_part(url, '/', -1) IN (SELECT split_part(url, '/', -1) FROM pages WHERE page_id % 3 = 0)""")
_register("source_exclusion_list", lambda s, d: files.excluding(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").where("toxic = 1"), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_register("source_dense_labels", lambda s, d: dense_labels(table(s, d, "documents").select("doc_id", "source"), "source"), """
SELECT doc_id, source, CAST(CASE WHEN source IS NOT NULL THEN (SELECT count(DISTINCT source) FROM documents b WHERE b.source < a.source) END AS INTEGER) AS label FROM documents a""")
_register("source_path_keys", lambda s, d: table(s, d, "pages").select("page_id", files.base_name("url").alias("name"), files.parent_name("url").alias("parent")), "SELECT page_id, split_part(url, '/', -1) AS name, split_part(url, '/', -2) AS parent FROM pages")
_register(
    "mask_labels",
    lambda s, d: table(s, d, "lineitem").select(F.col("l_quantity").cast("int").alias("v")).groupBy("v").agg(F.count("*").alias("n")).select("v", "n", files.street_hazards_label(F.col("v")).alias("street"), files.defect_label(F.col("v") - 20).alias("defect"), files.lost_and_found_label(F.col("v")).alias("found"), files.blended(F.col("v") * 4, F.lit(100)).alias("blend"), files.overlay_mask(F.col("v") - 7, F.col("v") - 7).alias("overlay")),
    """SELECT CAST(l_quantity AS INTEGER) AS v, count(*) AS n, CASE WHEN CAST(l_quantity AS INTEGER) >= 14 THEN -1 ELSE CAST(l_quantity AS INTEGER) - 1 END AS street,
CASE WHEN l_quantity > 20 THEN -1 ELSE 0 END AS defect, CASE WHEN l_quantity = 1 THEN -1 ELSE 0 END AS found, least(255, CAST(l_quantity AS INTEGER) * 4 + 100) AS blend,
CASE WHEN l_quantity <> 7 THEN -1 ELSE 0 END AS overlay FROM lineitem GROUP BY l_quantity""",
)
_register(
    "run_length_masks",
    lambda s, d: table(s, d, "events").select("event_id", F.posexplode(augment.run_length_mask(F.array(F.pmod("event_id", F.lit(7)), F.lit(3), 12 - F.pmod("event_id", F.lit(7)) - 3), 3, 4)).alias("px", "v")),
    """SELECT event_id, CAST(px AS INTEGER) AS px, CASE WHEN (px % 4) * 3 + px // 4 >= event_id % 7 AND (px % 4) * 3 + px // 4 < event_id % 7 + 3 THEN 1 ELSE 0 END AS v
FROM events, (SELECT unnest(range(0, 12)) AS px)""",
)
_register("noise_uniform", lambda s, d: files.uniform_noise(s, embeddings(s, d), 64).select("id", F.posexplode("pixels").alias("px", "v"), "label"))
_register("noise_gaussian", lambda s, d: files.gaussian_noise(s, embeddings(s, d), 64).select("id", F.posexplode("pixels").alias("px", "v"), "label"))


def _annotations(s, d) -> augment.Annotations:
    """Orders as images, their lines as annotations, ship modes as categories."""
    lines = table(s, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 4).cast("int").alias("category_id"), F.col("l_quantity").alias("area"), F.lit(0).alias("iscrowd"))
    images = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return augment.Annotations(images, lines, table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


_register("annotation_images", lambda s, d: _annotations(s, d).image_ids(categories=[1, 2]), "SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber % 4 IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_linenumber % 4) = 2")
_register("annotation_excluded_images", lambda s, d: _annotations(s, d).images_without([3], min_width=100).select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 4 = 3)")

# ---------------------------------------------------------------- splits, benchmarks, queues


def _split(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    o = splits.OpenSetSplit(e, kuc=2, uuc_val=1, uuc_test=2, train=0.6, val=0.2, seed=None, order=F.col("id").cast("double"))
    return o.rows.select(F.col("id").alias("vec_id"), "label", "role", "stage")


_register("open_set_split", _split, """
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN label < 2 THEN 'kuc' WHEN label < 5 THEN 'uuc' ELSE 'kkc' END AS role,
  CASE WHEN label = 2 THEN 'val' WHEN label IN (3, 4) THEN 'test' WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train'
       WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS stage FROM r""")


def _benchmark(s, d, score=None) -> DataFrame:
    ctx = setup(s, d)
    rows = ctx.e
    bench = splits.Benchmark(rows.where("y >= 0"), {f"part{k}": rows.where(f"y < 0 AND id % 3 = {k}") for k in range(3)}, ctx.train, label="y")
    return bench.evaluate(lambda df: df.withColumn("score", F.round(C.ClassCenters(ctx.w).nearest("z") if score is None else score, 9)))


_BENCH = f"""{SQL},
s AS (SELECT y, round(sqrt(list_min(d)), 9) AS score, 'part' || id % 3 AS Dataset FROM lg WHERE y < 0
      UNION ALL SELECT y, round(sqrt(list_min(d)), 9), 'part' || k FROM lg, (SELECT unnest(range(0, 3)) AS k) WHERE y >= 0),
"""
_register("benchmark_table", lambda s, d: _rounded(_benchmark(s, d), "Dataset"), _BENCH + _metric_sql("s", "Dataset"))


def _mean_table(s, d):
    named = {"NearestCenter": None, "MaxLogit": detectors.MaxLogit(**COLUMNS).score_column()}
    results = None
    for name, score in named.items():
        r = _benchmark(s, d, score).withColumn("Detector", F.lit(name))
        results = r if results is None else results.unionByName(r)
    return splits.mean_by_detector(results).select("Detector", *[F.round(f"`{m}`", 6).alias(m.replace("-", "_")) for m in metrics.METRICS])


_register("benchmark_mean_by_detector", _mean_table, f"""{SQL},
b AS (SELECT id, y, 'NearestCenter' AS Detector, round(sqrt(list_min(d)), 9) AS score FROM lg UNION ALL SELECT id, y, 'MaxLogit', round(-m, 9) FROM lg),
s AS (SELECT y, score, Detector || '/' || id % 3 AS Dataset FROM b WHERE y < 0 UNION ALL SELECT y, score, Detector || '/' || k FROM b, (SELECT unnest(range(0, 3)) AS k) WHERE y >= 0),
{_metric_sql("s", "Dataset", '''
SELECT split_part(Dataset, '/', 1) AS Detector, round(avg(AUROC), 6) AS AUROC, round(avg(AUPR_IN), 6) AS AUPR_IN, round(avg(AUPR_OUT), 6) AS AUPR_OUT, round(avg(FPR95TPR), 6) AS FPR95TPR FROM r GROUP BY 1''')}""")
_register("vos_queue_last_n", lambda s, d: C.last_rows(table(s, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 50).select("event_type", "event_id", F.round("value", 6).alias("value")), """
SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50""")
_register(
    "running_centers",
    lambda s, d: C.running_means(table(s, d, "events").withColumn("batch", F.dayofmonth("ts") - 1), "value", "event_type", "batch").select("event_type", F.round("center", 6).alias("center")),
    """WITH RECURSIVE m AS (SELECT event_type, CAST(day(ts) - 1 AS INTEGER) AS b, avg(value) AS m FROM events GROUP BY 1, 2),
f AS (SELECT DISTINCT event_type, -1 AS b, 0::DOUBLE AS c FROM events
      UNION ALL SELECT f.event_type, f.b + 1, CASE WHEN m.m IS NULL THEN f.c ELSE (m.m + f.c * (f.b + 1)) / (f.b + 2) END
      FROM f LEFT JOIN m ON m.event_type = f.event_type AND m.b = f.b + 1 WHERE f.b < 30)
SELECT event_type, round(c, 6) AS center FROM f WHERE b = 30""",
)


def _virtual(s, d):
    ctx = setup(s, d)
    queue = C.last_rows(ctx.train, "y", "id", 20)
    return C.virtual_outliers(queue, "z", "y", sample_from=2000, select=3).select("label", "rank", F.round(V.norm("features"), 6).alias("norm"))


_register("vos_synthesis", _virtual)


def _weibull(s, d):
    d = table(s, d, "events").select("event_id", F.col("value").alias("distance"))
    return classwise.with_weibull(d, "distance", "p", 1.7, 40.0, 0.0, shift=1.0).select("event_id", F.round("p", 6).alias("p"))


_register("weibull_cdf", _weibull, "SELECT event_id, round(1 - exp(-power((value + 1) / 40::DOUBLE, 1.7::DOUBLE)), 6) AS p FROM events")

# ---------------------------------------------------------------- scale test: four features of every order line

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_items(s, d):
    """Distance to the nearest class mean of standardised order lines; lines returned (R) are the outliers."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), *_LINE)
    stats = li.where("flag <> 'R'").agg(*[F.avg(c).alias(f"m_{c}") for c in _LINE], *[F.stddev_pop(c).alias(f"s_{c}") for c in _LINE]).first()
    z = li.select("l_orderkey", "l_linenumber", "flag", *[((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])).alias(c) for c in _LINE])
    means = z.where("flag <> 'R'").groupBy("flag").agg(*[F.avg(c).alias(c) for c in _LINE]).orderBy("flag").collect()
    nearest = F.least(*[sum(((F.col(c) - F.lit(m[c])) * (F.col(c) - F.lit(m[c])) for c in _LINE), F.lit(0.0)) for m in means])
    return z.select("l_orderkey", "l_linenumber", F.when(F.col("flag") == "R", -1).otherwise(0).alias("y"), F.round(F.sqrt(nearest), 6).alias("score"))


_Z = ", ".join(f"(({c} - avg({c}) FILTER (l_returnflag <> 'R') OVER ()) / stddev_pop({c}) FILTER (l_returnflag <> 'R') OVER ()) AS {c}" for c in _LINE)
_LINE_SQL = f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_returnflag AS flag, {_Z} FROM lineitem),
m AS (SELECT {", ".join(f"avg({c}) FILTER (flag = '{f}') AS {f}{i}" for f in "AN" for i, c in enumerate(_LINE))} FROM z),
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN z.flag = 'R' THEN -1 ELSE 0 END AS y,
      round(sqrt(least({", ".join(" + ".join(f"({c} - {f}{i}) * ({c} - {f}{i})" for i, c in enumerate(_LINE)) for f in "AN")})), 6) AS score FROM z, m)"""
_register("lineitem_scores", _line_items, f"{_LINE_SQL}\nSELECT * FROM s")
_register("lineitem_metrics", lambda s, d: _rounded(metrics.ood_metrics(_line_items(s, d), label="y")), f"{_LINE_SQL},\n{_metric_sql('s')}")


def _line_mahalanobis(s, d):
    """Mahalanobis scores of all order lines: two passes of sums, then one matrix product a batch."""
    from ..operators.gaussian import Mahalanobis

    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col(c) for c in _LINE]).alias("z"), F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("y"))
    det = Mahalanobis(features="z", label="y").fit_features(li)
    return det.predict_features(li).select("l_orderkey", "l_linenumber", F.round("score", 5).alias("score"))


_GAUSS_Z = f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in _LINE)}]"
_register("lineitem_mahalanobis", _line_mahalanobis, f"""WITH RECURSIVE li AS (SELECT row_number() OVER () AS at_row, l_orderkey, l_linenumber, {_GAUSS_Z} AS z, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN -1 ELSE 1 END AS y FROM lineitem),
lt AS (SELECT * FROM li WHERE y >= 0)
{gauss_sql("f", len(_LINE))}{gauss_distance("f", len(_LINE), "li", keys="at_row, l_orderkey, l_linenumber")}
SELECT l_orderkey, l_linenumber, round(d2 / 2, 5) AS score FROM fd""")
