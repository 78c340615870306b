"""Registered queries of detectors, centres, metrics and losses, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import heads as H
from ..functions import labels as L
from ..functions import scores as S
from ..functions import vectors as V
from ..operators import centers as C
from ..operators import classwise, detectors, gaussian, losses, metrics
from .setup import SQL, Setup, embeddings, setup, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COLUMNS = {"features": "z", "logits": "l", "label": "y"}


def _scores(df: DataFrame, score: Column | str = "score") -> DataFrame:
    s = F.col(score) if isinstance(score, str) else score
    return df.select(F.col("id").alias("vec_id"), "y", F.round(s, 6).alias("score"))


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _expression(name: str, score: Callable[[Setup], Column], sql: str, ctes: str = "", source: str = "lg") -> None:
    _register(
        name,
        lambda spark, d: _scores((s := setup(spark, d)).e, score(s)),
        f"{SQL}{ctes}\nSELECT id AS vec_id, y, round({sql}, 6) AS score FROM {source}",
    )


def _detector(name: str, make: Callable[[Setup], detectors.Detector], oracle: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = setup(spark, d)
        det = make(s)
        if det.needs_fit:
            det.fit_features(s.train)
        return _scores(det.predict_features(s.e))

    _register(name, query, oracle)


# ---------------------------------------------------------------- labels and centres


def _labels(spark, d):
    e = table(spark, d, "embeddings").select(F.when(F.col("label") < 8, F.col("label")).otherwise(-F.col("label")).cast("int").alias("y"))
    return e.groupBy("y").agg(L.contains_known("y").alias("known"), L.contains_unknown("y").alias("unknown"), L.contains_known_and_unknown("y").alias("mixed"), F.count("*").alias("n"))


_register("labels_known_unknown", _labels, """
SELECT CAST(CASE WHEN label < 8 THEN label ELSE -label END AS INTEGER) AS y, bool_or(label < 8) AS known, bool_or(label >= 8) AS unknown,
       bool_or(label < 8) AND bool_or(label >= 8) AS mixed, count(*) AS n FROM embeddings GROUP BY 1""")
_register(
    "target_mapping",
    lambda spark, d: table(spark, d, "embeddings").select("label", L.TargetMapping([2, 3, 5, 7], [0, 8])("label").alias("target")).groupBy("label", "target").agg(F.count("*").alias("n")),
    """SELECT label, CASE label WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 WHEN 0 THEN -1 WHEN 8 THEN -9 ELSE -1 END AS target, count(*) AS n
FROM embeddings GROUP BY 1, 2""",
)
_register(
    "openness",
    lambda spark, d: table(spark, d, "embeddings").agg(F.countDistinct(F.when(F.col("label") < 8, F.col("label"))).alias("a"), F.countDistinct("label").alias("b")).select(F.round(metrics.openness(F.col("a"), F.col("b"), F.col("a")), 6).alias("openness")),
    """SELECT round(1 - sqrt(2::DOUBLE * a / (b + a)), 6) AS openness
FROM (SELECT count(DISTINCT CASE WHEN label < 8 THEN label END) AS a, count(DISTINCT label) AS b FROM embeddings)""",
)
_register(
    "class_centers",
    lambda spark, d: C.class_center_table(embeddings(spark, d), "z", "y", n_classes=9).select("label", F.posexplode("center").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m")),
    """WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS z, label FROM embeddings WHERE label < 8),
m AS (SELECT label, i, avg(z[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS pos, round(coalesce(m, 0), 6) AS m
FROM (SELECT unnest(range(0, 9)) AS k) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN m USING (i) WHERE m.label = k
UNION ALL SELECT 8, CAST(i - 1 AS INTEGER), 0::DOUBLE FROM (SELECT unnest(range(1, 65)) AS i)""",
)


def _per_class(name: str, column: Callable[[Setup], Column], sql: str) -> None:
    _register(
        name,
        lambda spark, d: (s := setup(spark, d)).e.select(F.col("id").alias("vec_id"), F.posexplode(column(s)).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("v")),
        f"{SQL}\nSELECT id AS vec_id, CAST(k - 1 AS INTEGER) AS k, round({sql}, 6) AS v FROM lg, (SELECT unnest(range(1, 9)) AS k)",
    )


_per_class("pairwise_squared_distances", lambda s: C.ClassCenters(s.w).squared_distances("z"), "d[k]")
_per_class("center_distances", lambda s: C.ClassCenters(s.w).distances("z"), "sqrt(d[k])")
_per_class("center_softmin", lambda s: C.ClassCenters(s.w).predict("z"), "exp(-d[k]) / list_sum([exp(-x) for x in d])")
_per_class("logits_head", lambda s: F.col("l"), "l[k]")
_per_class("softmax_probabilities", lambda s: V.softmax("l"), "exp(l[k] - lse)")

# ---------------------------------------------------------------- expressions

_EBO = "[0.5::DOUBLE, 1, 2, 0, -1, 1, 1, 3]"
_detector("max_softmax", lambda s: detectors.MaxSoftmax(**COLUMNS), f"{SQL}\nSELECT id AS vec_id, y, round(-exp(m - lse), 6) AS score FROM lg")
_expression("max_softmax_t2", lambda s: S.max_softmax("l", 2.0), "-1 / list_sum([exp((x - m) / 2) for x in l])")
_detector("max_logit", lambda s: detectors.MaxLogit(**COLUMNS), f"{SQL}\nSELECT id AS vec_id, y, round(-m, 6) AS score FROM lg")
_detector("energy", lambda s: detectors.EnergyBased(**COLUMNS), f"{SQL}\nSELECT id AS vec_id, y, round(-lse, 6) AS score FROM lg")
_expression("energy_t2", lambda s: S.energy("l", 2.0), "-2 * (m / 2 + ln(list_sum([exp((x - m) / 2) for x in l])))")
_detector(
    "weighted_energy",
    lambda s: detectors.WeightedEBO(weights=[0.5, 1, 2, 0, -1, 1, 1, 3], **COLUMNS),
    f"{SQL}\nSELECT id AS vec_id, y, round(-ln(list_sum([greatest({_EBO}[i], 0) * exp(l[i]) for i in range(1, 9)])), 6) AS score FROM lg",
)
_detector("entropy", lambda s: detectors.Entropy(**COLUMNS), f"{SQL}\nSELECT id AS vec_id, y, round(-list_sum([exp(x - lse) * (x - lse) for x in l]), 6) AS score FROM lg")
_expression("objectosphere_score", lambda s: S.objectosphere("l"), "-exp(m - lse) * sqrt(list_inner_product(l, l))")
_expression("class_anchor_score", lambda s: S.class_anchor(C.ClassCenters(s.w).squared_distances("z")), "-list_max([x * (1 - exp(-x) / list_sum([exp(-q) for q in d])) for x in d])")
_expression("nearest_center", lambda s: C.ClassCenters(s.w).nearest("z"), "sqrt(list_min(d))")

_LOGITS2 = """,
x2 AS (SELECT id, y, list(list_inner_product(v, w) - 0.5::DOUBLE * list_inner_product(w, w) ORDER BY k) AS l FROM x1, h GROUP BY id, y),
x3 AS (SELECT *, list_max(l) AS m FROM x2)"""
_MSP2 = "-1 / list_sum([exp(x - m) for x in l])"
_EN2 = "-(m + ln(list_sum([exp(x - m) for x in l])))"


def _shaped(ctes: str, score: str) -> str:
    return f"{SQL},\n{ctes}{_LOGITS2}\nSELECT id AS vec_id, y, round({score}, 6) AS score FROM x3"


_detector("odin_linear", lambda s: detectors.ODIN(weights=s.w, bias=s.b, eps=0.05, **COLUMNS), _shaped("x1 AS (SELECT id, y, [z[i] + 0.05::DOUBLE * sign(w[i]) for i in range(1, 65)] AS v FROM lg JOIN h ON h.k = yhat)", _MSP2))
_detector("react", lambda s: detectors.ReAct(threshold=0.1, weights=s.w, bias=s.b, **COLUMNS), _shaped("x1 AS (SELECT id, y, [least(q, 0.1::DOUBLE) for q in z] AS v FROM lg)", _EN2))
_ASH = """r AS (SELECT id, y, i, z[i] AS v, row_number() OVER (PARTITION BY id ORDER BY z[i] DESC, i) AS r FROM lg, (SELECT unnest(range(1, 65)) AS i)),
t AS (SELECT id, sum(v) AS s1, sum(CASE WHEN r <= 22 THEN v ELSE 0 END) AS s2 FROM r GROUP BY id),
x1 AS (SELECT id, y, list({0} ORDER BY i) AS v FROM r JOIN t USING (id) GROUP BY id, y)"""
for _v, _sql in (("ash-p", "CASE WHEN r <= 22 THEN v ELSE 0 END"), ("ash-b", "CASE WHEN r <= 22 THEN s1 / 22 ELSE 0 END"), ("ash-s", "CASE WHEN r <= 22 THEN v * exp(s1 / s2) ELSE 0 END")):
    if _v != "ash-s":
        _detector(_v.replace("-", "_"), lambda s, v=_v: detectors.ASH(variant=v, weights=s.w, bias=s.b, **COLUMNS), _shaped(_ASH.format(_sql), _EN2))

# the scaling of ash-s needs a positive sum, so its query shifts the features first
_register(
    "ash_s",
    lambda spark, d: _scores((s := setup(spark, d)).e.select("id", "y", F.transform("z", lambda v: v + F.lit(1.0)).alias("z")), S.energy(V.linear(S.ash_s("z"), s.w, s.b))),
    _shaped(_ASH.format("CASE WHEN r <= 22 THEN v * exp(s1 / s2) ELSE 0 END").replace("z[i] AS v", "z[i] + 1 AS v"), _EN2),
)
_detector(
    "dice",
    lambda s: detectors.DICE(p=70.0, weights=s.w, bias=s.b, **COLUMNS),
    f"""{SQL},
zm AS (SELECT i, avg(z[i]) AS q FROM lt, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
ct AS (SELECT k, i, w[i] AS wi, q * w[i] AS c FROM h, zm),
th AS (SELECT quantile_cont(c, 0.7) AS t FROM ct),
mw AS (SELECT k, list(CASE WHEN c > t THEN wi ELSE 0 END ORDER BY i) AS mw FROM ct, th GROUP BY k),
x2 AS (SELECT id, y, list(list_inner_product(z, mw) - 0.5::DOUBLE * list_inner_product(w, w) ORDER BY h.k) AS l FROM lg, h JOIN mw USING (k) GROUP BY id, y),
x3 AS (SELECT *, list_max(l) AS m FROM x2)
SELECT id AS vec_id, y, round({_EN2}, 6) AS score FROM x3""",
)
_DROP = "(id * 31 + n * 17 + i) % 10 < 5"
_MCD = f"""{SQL},
nn AS (SELECT id, y, z, unnest(range(1, 6)) AS n FROM lg),
mk AS (SELECT id, y, n, [CASE WHEN {_DROP} THEN 0 ELSE 2 * z[i + 1] END for i in range(0, 64)] AS v FROM nn),
ml AS (SELECT id, y, n, list(list_inner_product(v, w) - 0.5::DOUBLE * list_inner_product(w, w) ORDER BY k) AS l FROM mk, h GROUP BY id, y, n),
mp AS (SELECT id, y, n, [exp(x - list_max(l)) / list_sum([exp(q - list_max(l)) for q in l]) for x in l] AS p FROM ml),
mu AS (SELECT id, y, k, avg(p[k]) AS a, var_samp(p[k]) AS s FROM mp, (SELECT unnest(range(1, 9)) AS k) GROUP BY id, y, k)"""


def _mcd(mode: str):
    drop = lambda row, n, i: (row * 31 + n * 17 + i) % 10 < 5
    return lambda s: detectors.MCD(weights=s.w, bias=s.b, samples=5, mode=mode, drop=drop, **COLUMNS)


_detector("mcd_mean", _mcd("mean"), f"{_MCD}\nSELECT id AS vec_id, y, round(-max(a), 6) AS score FROM mu GROUP BY id, y")
_detector("mcd_var", _mcd("var"), f"{_MCD}\nSELECT id AS vec_id, y, round(avg(s), 6) AS score FROM mu GROUP BY id, y")

# ---------------------------------------------------------------- fitted detectors


def _kl(spark, d):
    s = setup(spark, d)
    det = classwise.KLMatching(lambda df: df, **COLUMNS).fit(s.train)
    return _scores(det.predict(s.e))


_register("kl_matching", _kl, f"""{SQL},
pm AS (SELECT y AS k, i, avg(exp(l[i] - lse)) AS q FROM lt, (SELECT unnest(range(1, 9)) AS i) GROUP BY 1, 2),
pl AS (SELECT k, list(q ORDER BY i) AS q FROM pm GROUP BY k)
SELECT id AS vec_id, y, round(list_sum([exp(l[i] - lse) * (l[i] - lse - ln(q[i])) for i in range(1, 9)]), 6) AS score FROM lg JOIN pl ON k = yhat""")
_detector("she", lambda s: classwise.SHE(weights=s.w, bias=s.b, **COLUMNS), f"""{SQL},
sm AS (SELECT y AS k, i, avg(z[i]) AS q FROM lt, (SELECT unnest(range(1, 65)) AS i) WHERE yhat = y GROUP BY 1, 2),
sl AS (SELECT k, list(q ORDER BY i) AS q FROM sm GROUP BY k)
SELECT id AS vec_id, y, round(-list_inner_product(z, q), 6) AS score FROM lg JOIN sl ON k = yhat""")
_detector("knn", lambda s: classwise.KNN(**COLUMNS), f"""{SQL}
SELECT g.id AS vec_id, g.y, round(sqrt(min(list_sum([(g.z[i] - t.z[i]) * (g.z[i] - t.z[i]) for i in range(1, 65)]))), 6) AS score FROM lg g, lt t GROUP BY 1, 2""")


def _plane(cls):
    def query(spark, d):
        s = setup(spark, d)
        cut = lambda df: df.select("id", "y", F.slice("z", 1, 2).alias("a"))
        return _scores(cls(features="a", label="y").fit_features(cut(s.train)).predict_features(cut(s.e)))

    return query


def _layers(spark, d):
    """Two layers, the first and the second half of the features."""
    s = setup(spark, d)
    cut = lambda df: df.select("id", "y", F.slice("z", 1, 32).alias("a"), F.slice("z", 33, 32).alias("b"))
    det = gaussian.MultiMahalanobis(layers=["a", "b"], alpha=[1.0, 0.5], label="y")
    return _scores(det.fit_features(cut(s.train)).predict_features(cut(s.e)))


def _gauss(name: str, i: int) -> str:
    x, y = f"z[{i}]", f"z[{i + 1}]"
    return f""",
{name}m AS (SELECT y AS k, avg({x}) AS mx, avg({y}) AS my FROM lt GROUP BY y),
{name}c AS (SELECT sum(({x} - mx) * ({x} - mx)) / (count(*) - 1) + 1e-6::DOUBLE AS a, sum(({y} - my) * ({y} - my)) / (count(*) - 1) + 1e-6::DOUBLE AS b,
        sum(({x} - mx) * ({y} - my)) / (count(*) - 1) AS c FROM lt JOIN {name}m ON k = y),
{name}d AS (SELECT id, y, min((({x} - mx) * ({x} - mx) * b + ({y} - my) * ({y} - my) * a - 2 * ({x} - mx) * ({y} - my) * c) / (a * b - c * c)) AS d2
       FROM lg, {name}m, {name}c GROUP BY id, y)"""


_register("mahalanobis_2d", _plane(gaussian.Mahalanobis), f"{SQL}{_gauss('g', 1)}\nSELECT id AS vec_id, y, round(d2 / 2, 6) AS score FROM gd")
_register("rmd_2d", _plane(gaussian.RMD), f"""{SQL}{_gauss('g', 1)},
bm AS (SELECT avg(z[1]) AS mx, avg(z[2]) AS my FROM lt),
bc AS (SELECT any_value(mx) AS mx, any_value(my) AS my, sum((z[1] - mx) * (z[1] - mx)) + 1e-6::DOUBLE AS a, sum((z[2] - my) * (z[2] - my)) + 1e-6::DOUBLE AS b,
       sum((z[1] - mx) * (z[2] - my)) AS c FROM lt, bm)
SELECT id AS vec_id, lg.y, round(d2 - ((z[1] - mx) * (z[1] - mx) * b + (z[2] - my) * (z[2] - my) * a - 2 * (z[1] - mx) * (z[2] - my) * c) / (a * b - c * c), 6) AS score
FROM lg JOIN gd USING (id), bc""")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def gauss_sql(name: str, dim: int, source: str = "lt", vector: str = "z", *, background: bool = False) -> str:
    """CTEs ``<name>m`` (class k, mean mu) and ``<name>`` (row i and its entries p of the inverse): the pooled covariance of ``source`` plus the ridge.

    The inverse is by Gauss and Jordan, a recursion step for each pivot. With ``background`` there is one mean, and the scatter isn't
    divided by the number of rows.
    """
    k = "0" if background else "y"
    over = "" if background else " / (any_value(n) - 1)"
    return f""",
{name}v AS (SELECT {k} AS k, {vector} AS v FROM {source}),
{name}m AS (SELECT k, list(a ORDER BY i) AS mu FROM (SELECT k, i, avg(v[i]) AS a FROM {name}v, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY k, i) GROUP BY k),
{name}r AS (SELECT [v[i] - mu[i] for i in range(1, {dim + 1})] AS d, count(*) OVER () AS n FROM {name}v JOIN {name}m USING (k)),
{name}c AS (SELECT i, j, sum(d[i] * d[j]){over} + CASE WHEN i = j THEN 1e-6::DOUBLE ELSE 0 END AS v
       FROM {name}r, (SELECT unnest(range(1, {dim + 1})) AS i), (SELECT unnest(range(1, {dim + 1})) AS j) GROUP BY i, j),
{name}g AS (SELECT 1 AS k, i, list(v ORDER BY j) || [CASE WHEN q = i THEN 1::DOUBLE ELSE 0 END for q in range(1, {dim + 1})] AS r FROM {name}c GROUP BY i
       UNION ALL SELECT k + 1, i, CASE WHEN i = k THEN list_transform(r, lambda x: x / h) ELSE list_transform(list_zip(r, t), lambda x: x[1] - f / h * x[2]) END
       FROM (SELECT *, r[k] AS f, t[k] AS h FROM (SELECT *, any_value(CASE WHEN i = k THEN r END) OVER () AS t FROM {name}g WHERE k <= {dim}))),
{name} AS (SELECT i, r[{dim + 1}:] AS p FROM {name}g WHERE k = {dim + 1})"""


def gauss_distance(name: str, dim: int, source: str = "lg", vector: str = "z", keys: str = "id, y") -> str:
    """CTE ``<name>d``: the smallest squared distance d2 of each row to a mean of :func:`gauss_sql`."""
    return f""",
{name}x AS (SELECT {keys}, {name}m.k AS c, [{vector}[i] - mu[i] for i in range(1, {dim + 1})] AS d FROM {source}, {name}m),
{name}s AS (SELECT {keys}, c, sum(d[i] * list_inner_product(p, d)) AS d2 FROM {name}x, {name} GROUP BY {keys}, c),
{name}d AS (SELECT {keys}, min(d2) AS d2 FROM {name}s GROUP BY {keys})"""


_register("multi_mahalanobis", _layers, _recursive(f"""{SQL},
ha AS (SELECT id, y, z[1:32] AS a, z[33:64] AS b FROM lg), hl AS (SELECT * FROM ha WHERE id % 2 = 0 AND y >= 0)
{gauss_sql("fa", 32, "hl", "a")}{gauss_sql("fb", 32, "hl", "b")}{gauss_distance("fa", 32, "ha", "a")}{gauss_distance("fb", 32, "ha", "b")}
SELECT id AS vec_id, fad.y, round(fad.d2 / 2 + 0.5::DOUBLE * fbd.d2 / 2, 6) AS score FROM fad JOIN fbd USING (id)"""))
_detector("mahalanobis", lambda s: gaussian.Mahalanobis(**COLUMNS), _recursive(f"{SQL}{gauss_sql('f', 64)}{gauss_distance('f', 64)}\nSELECT id AS vec_id, y, round(d2 / 2, 6) AS score FROM fd"))
_detector("rmd", lambda s: gaussian.RMD(**COLUMNS), _recursive(f"""{SQL}{gauss_sql("f", 64)}{gauss_sql("b", 64, background=True)}{gauss_distance("f", 64)}{gauss_distance("b", 64)}
SELECT id AS vec_id, fd.y, round(fd.d2 - bd.d2, 6) AS score FROM fd JOIN bd USING (id)"""))


def _maps(spark, d):
    """Feature maps: the features as 4 channels of 16 positions and as 8 of 8, whose channel means count."""
    s = setup(spark, d)
    channels = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice("z", k * (64 // n) + 1, 64 // n))
    cut = lambda df: df.select("id", "y", channels(4).alias("a"), channels(8).alias("b"))
    det = gaussian.MultiMahalanobis(layers=["a", "b"], label="y")
    return _scores(det.fit_features(cut(s.train)).predict_features(cut(s.e)))


_register("multi_mahalanobis_maps", _maps, _recursive(f"""{SQL},
ha AS (SELECT id, y, [list_avg(z[16 * k + 1 : 16 * k + 16]) for k in range(0, 4)] AS a, [list_avg(z[8 * k + 1 : 8 * k + 8]) for k in range(0, 8)] AS b FROM lg),
hl AS (SELECT * FROM ha WHERE id % 2 = 0 AND y >= 0)
{gauss_sql("fa", 4, "hl", "a")}{gauss_sql("fb", 8, "hl", "b")}{gauss_distance("fa", 4, "ha", "a")}{gauss_distance("fb", 8, "ha", "b")}
SELECT id AS vec_id, fad.y, round(fad.d2 / 2 + fbd.d2 / 2, 6) AS score FROM fad JOIN fbd USING (id)"""))


def _plane_head(s):
    """A linear layer that picks the first two features: the fit and the scores are on its outputs."""
    return gaussian.Mahalanobis(head=H.Head([H.Linear(np.eye(2, 64), np.zeros(2))]), **COLUMNS)


_detector("mahalanobis_layers", _plane_head, ORACLES["mahalanobis_2d"])
_detector("odin_layers", lambda s: detectors.ODIN(head=H.linear_head(s.w, s.b), eps=0.05, **COLUMNS), ORACLES["odin_linear"])
_detector("mcd_layers", lambda s: detectors.MCD(head=H.Head([H.Tanh(), H.Dropout(0.3), *H.linear_head(s.w, s.b).layers]), samples=10, **COLUMNS))
_detector("vim", lambda s: gaussian.ViM(d=16, weights=s.w, bias=s.b, **COLUMNS))
_detector("openmax", lambda s: classwise.OpenMax(**COLUMNS))
_detector("temperature_scaling", lambda s: detectors.TemperatureScaling(**COLUMNS))


def _tails(spark, d):
    s = setup(spark, d)
    means = classwise.class_means(s.train, "l", "y")
    t = classwise.class_tails(s.train, "l", "y", {k: m for k, (_, m) in means.items()}, 25)
    return t.select("label", F.round("distance", 6).alias("distance"))


_register("openmax_tails", _tails, f"""{SQL},
lm AS (SELECT y AS k, i, avg(l[i]) AS q FROM lt, (SELECT unnest(range(1, 9)) AS i) GROUP BY 1, 2),
ll AS (SELECT k, list(q ORDER BY i) AS q FROM lm GROUP BY k),
td AS (SELECT y AS label, sqrt(list_sum([(l[i] - q[i]) * (l[i] - q[i]) for i in range(1, 9)])) AS distance FROM lt JOIN ll ON k = y)
SELECT label, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance DESC) AS r FROM td) WHERE r <= 25""")

# ---------------------------------------------------------------- metrics


def _scored(spark, d):
    s = setup(spark, d)
    return s.e.select("id", "y", F.round(C.ClassCenters(s.w).nearest("z"), 9).alias("score"), (F.col("id") % 5).alias("image_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("Dataset"))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(f"`{m}`"), 6).alias(m.replace("-", "_")) for m in metrics.METRICS])


def _metric_sql(source: str, by: str = "", final: str | None = None) -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    cols = {
        "AUROC": "sum(n * (tp + tp - p) / 2) / (max(np) * max(nn))",
        "AUPR_IN": "sum(n * (CASE WHEN nn - fp + n + np - tp + p > 0 THEN (nn - fp + n) / (nn - fp + n + np - tp + p) ELSE 1 END + CASE WHEN nn - fp + np - tp > 0 THEN (nn - fp) / (nn - fp + np - tp) ELSE 1 END) / 2) / max(nn)",
        "AUPR_OUT": "sum(p * (tp / (tp + fp) + CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n) ELSE 1 END) / 2) / max(np)",
        "FPR95TPR": "min(CASE WHEN tp >= 0.95::DOUBLE * np THEN fp END) / max(nn)",
    }
    wrap = "{}" if final else "round({}, 6)"
    select = ", ".join(f"{wrap.format(v)} AS {k}" for k, v in cols.items())
    body = f"""g AS (SELECT {lead}score, sum(CASE WHEN y < 0 THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y >= 0 THEN 1 ELSE 0 END)::DOUBLE AS n FROM {source} GROUP BY {lead}score),
c AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
      sum(p) OVER ({part}) AS np, sum(n) OVER ({part}) AS nn FROM g),
r AS (SELECT {lead}{select} FROM c {group})"""
    return body + ("\nSELECT * FROM r" if final is None else final)


_SCORED = f"{SQL},\ns AS (SELECT id, y, round(sqrt(list_min(d)), 9) AS score, id % 5 AS image_id, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS Dataset FROM lg),\n"
_MEAN = "\nSELECT round(avg(AUROC), 6) AS AUROC, round(avg(AUPR_IN), 6) AS AUPR_IN, round(avg(AUPR_OUT), 6) AS AUPR_OUT, round(avg(FPR95TPR), 6) AS FPR95TPR FROM r"
_register("ood_metrics", lambda spark, d: _rounded(metrics.ood_metrics(_scored(spark, d), label="y")), _SCORED + _metric_sql("s"))
_register("ood_metrics_by_dataset", lambda spark, d: _rounded(metrics.ood_metrics(_scored(spark, d), label="y", by=["Dataset"]), "Dataset"), _SCORED + _metric_sql("s", "Dataset"))
_register("ood_metrics_segmentation", lambda spark, d: _rounded(metrics.segmentation_metrics(_scored(spark, d), label="y")), _SCORED + _metric_sql("s", "image_id", _MEAN))
_register("ood_metrics_void", lambda spark, d: _rounded(metrics.OODMetrics(void_label=0).update(_scored(spark, d), label="y").compute()), _SCORED + "v AS (SELECT * FROM s WHERE y <> 0),\n" + _metric_sql("v"))


def _confidence(spark, d):
    s = setup(spark, d)
    return s.e.where("y >= 0").select("id", F.round(-S.max_softmax("l"), 9).alias("confidence"), (V.argmax("l") == F.col("y")).cast("int").alias("correct"))


_CONF = f"{SQL},\ncf AS (SELECT id, round(exp(m - lse), 9) AS confidence, CAST(yhat = y AS INTEGER) AS correct FROM la WHERE y >= 0),\n"
_BINS = """rk AS (SELECT *, row_number() OVER (ORDER BY confidence, correct, id) AS r, count(*) OVER () AS n FROM cf),
bn AS (SELECT (r - 1) // 20 AS bin, abs(avg(confidence) - avg(correct)) AS gap, count(*)::DOUBLE / max(n) AS share FROM rk WHERE (r - 1) // 20 < n // 20 - 1 GROUP BY 1)
"""
for _p, _sql in (("1", "sum(share * gap)"), ("2", "sqrt(sum(share * gap * gap))"), ("infty", "max(gap)")):
    _register(
        f"calibration_error_{_p}",
        lambda spark, d, p=_p: metrics.calibration_error(_confidence(spark, d), p=p, beta=20).select(F.round("calibration_error", 6).alias("calibration_error")),
        f"{_CONF}{_BINS}SELECT round({_sql}, 6) AS calibration_error FROM bn",
    )
_register(
    "aurra",
    lambda spark, d: metrics.aurra(_confidence(spark, d)).select(F.round("aurra", 6).alias("aurra")),
    f"""{_CONF}rk AS (SELECT sum(correct) OVER (ORDER BY confidence DESC, correct, id ROWS UNBOUNDED PRECEDING)::DOUBLE / row_number() OVER (ORDER BY confidence DESC, correct, id) AS a FROM cf)
SELECT round(avg(a), 6) AS aurra FROM rk""",
)


def _temperature(spark, d):
    s = setup(spark, d)
    t = metrics.temperature_calibration(s.e, "l", "y")
    return spark.createDataFrame([(round(t, 2),)], "temperature double")


_register("temperature_bisection", _temperature)
_register(
    "energy_logistic_means",
    lambda spark, d: metrics.energy_logistic_loss(setup(spark, d).e, "l", "y", weight=0.7, bias=-0.2).select(*[F.round(c, 6).alias(c) for c in ("sigmoid", "energy_bce", "cross_entropy")]),
    f"""{SQL}
SELECT round(avg(1 / (1 + exp(-(0.7::DOUBLE * lse - 0.2::DOUBLE)))), 6) AS sigmoid, round(avg(ln(1 + exp(0.7::DOUBLE * lse - 0.2::DOUBLE))), 6) AS energy_bce,
       round(avg(lse - l[y + 1]), 6) AS cross_entropy FROM la WHERE y >= 0""",
)

# ---------------------------------------------------------------- losses

_CE = "CASE WHEN y >= 0 THEN lse - l[y + 1] ELSE 0 END"
_OPEN = "CASE WHEN y >= 0 THEN lse - l[y + 1] ELSE lse - list_avg(l) END"
_WE = "(-ln(list_sum([i * exp(l[i]) for i in range(1, 9)])))"
_PAIR = f"(ln(exp(0.5::DOUBLE * {_WE} + 0.1::DOUBLE) + exp(-0.5::DOUBLE * {_WE})) - CASE WHEN y >= 0 THEN -0.5::DOUBLE * {_WE} ELSE 0.5::DOUBLE * {_WE} + 0.1::DOUBLE END)"
_WEIGHTS = np.arange(1.0, 9.0)


def _d2(s: Setup) -> Column:
    return C.ClassCenters(s.w).squared_distances("z")


_ROW_LOSSES: dict[str, tuple[Callable[[Setup], Column], str]] = {
    "cross_entropy": (lambda s: losses.cross_entropy("l", "y"), _CE),
    "background_class": (lambda s: losses.background_class(F.concat("l", F.array(F.lit(0.1))), "y", 8), "ln(exp(lse) + exp(0.1::DOUBLE)) - CASE WHEN y >= 0 THEN l[y + 1] ELSE 0.1::DOUBLE END"),
    "outlier_exposure": (lambda s: losses.outlier_exposure("l", "y", 0.5), "CASE WHEN y >= 0 THEN lse - l[y + 1] ELSE 0.5::DOUBLE * (lse - list_avg(l)) END"),
    "entropic_open_set": (lambda s: losses.entropic_open_set("l", "y"), _OPEN),
    "objectosphere": (lambda s: losses.objectosphere("l", "z", "y", 0.3, 1.5), f"{_OPEN} + 0.3::DOUBLE * CASE WHEN y >= 0 THEN power(greatest(1.5::DOUBLE - sqrt(list_inner_product(z, z)), 0), 2) ELSE list_inner_product(z, z) END"),
    "energy_regularised": (lambda s: losses.energy_regularised("l", "y", 0.4, -3.0, -1.0), f"{_CE} + 0.4::DOUBLE * CASE WHEN y >= 0 THEN power(greatest(-lse + 3, 0), 2) ELSE power(greatest(-1 + lse, 0), 2) END"),
    "vos": (lambda s: losses.vos_regularised("l", "y", _WEIGHTS, (0.5, -0.5), (0.1, 0.0), 0.1), f"{_CE} + 0.1::DOUBLE * {_PAIR}"),
    "center": (lambda s: losses.center(_d2(s), "y", 0.2), "CASE WHEN y >= 0 THEN (greatest(d[y + 1] - 0.2::DOUBLE, 1e-12::DOUBLE) + 7 * 1e-12::DOUBLE) / 8 END"),
    "class_anchor": (lambda s: losses.class_anchor(_d2(s), "y", 0.1), "CASE WHEN y >= 0 THEN 0.1::DOUBLE * d[y + 1] + ln(1 + list_sum([exp(least(d[y + 1] - x, 50)) for x in d[1:7]])) END"),
    "center_regularisation": (lambda s: losses.center_regularisation(_d2(s), "y", 1.2), "CASE WHEN y < 0 THEN list_sum([greatest(1.44::DOUBLE - x * x, 0) for x in d]) END"),
    "deep_svdd": (lambda s: losses.deep_svdd("z", s.w[0], "y", 0.5), "CASE WHEN y >= 0 THEN greatest(d[1] - 0.25::DOUBLE, 0) ELSE 0 END"),
    "semi_supervised_svdd": (lambda s: losses.semi_supervised_svdd("z", s.w[0], "y"), "CASE WHEN y >= 0 THEN d[1] * d[1] ELSE 1 / (d[1] * d[1]) END"),
}
for _n, (_f, _sql) in _ROW_LOSSES.items():
    _register(
        f"loss_{_n}",
        lambda spark, d, f=_f: (s := setup(spark, d)).e.agg(F.round(losses.reduced(f(s), "mean"), 6).alias("mean_loss"), F.round(losses.reduced(f(s), "sum"), 4).alias("sum_loss")),
        f"{SQL}\nSELECT round(avg({_sql}), 6) AS mean_loss, round(sum({_sql}), 4) AS sum_loss FROM la",
    )


def _loss(name: str, query: Callable[[Setup], DataFrame], sql: str) -> None:
    _register(f"loss_{name}", lambda spark, d: query(setup(spark, d)).select(F.round("loss", 5).alias("loss")), f"{SQL}\n{sql}" if not sql.startswith(",") else f"{SQL}{sql}")


_loss(
    "confidence",
    lambda s: losses.confidence_loss(s.e.withColumn("c", -S.max_softmax("l")), "l", "c", "y", 0.5),
    "SELECT round(sum(CASE WHEN y >= 0 THEN -ln(exp(m - lse) * exp(l[y + 1] - lse) + 1 - exp(m - lse)) END) + 0.5::DOUBLE * avg(lse - m), 5) AS loss FROM la",
)
_loss(
    "energy_segmentation",
    lambda s: losses.energy_segmentation(s.e, "l", "y", 0.4, -3.0, 3.0),
    f"""SELECT round(avg({_CE}) + 0.4::DOUBLE * (avg(CASE WHEN y >= 0 THEN power(greatest(-lse + 3, 0), 2) END)
    + avg(CASE WHEN y < 0 THEN power(greatest(-ln(list_sum([exp(3 - x) for x in l])), 0), 2) END)), 5) AS loss FROM la""",
)
_loss(
    "ii",
    lambda s: losses.ii_loss(s.train, "z", "y", 0.7),
    """SELECT round((SELECT avg(d[y + 1]) FROM lt) - 0.7::DOUBLE * (SELECT min(list_inner_product(a.w, a.w) - 2 * list_inner_product(a.w, b.w) + list_inner_product(b.w, b.w))
    FROM h a JOIN h b ON a.k < b.k), 5) AS loss""",
)
_loss(
    "mchad",
    lambda s: losses.mchad_loss(s.e.withColumn("d", _d2(s)), "d", "y", radius=0.2, margin=1.2, weight_center=0.5, weight_nll=1.5, weight_oe=0.1),
    """SELECT round(0.5::DOUBLE * avg(CASE WHEN y >= 0 THEN (greatest(d[y + 1] - 0.2::DOUBLE, 1e-12::DOUBLE) + 7 * 1e-12::DOUBLE) / 8 END)
    + 1.5::DOUBLE * avg(CASE WHEN y >= 0 THEN ln(list_sum([exp(-x) for x in d])) + d[y + 1] ELSE 0 END)
    + 0.1::DOUBLE * sum(CASE WHEN y < 0 THEN list_sum([greatest(1.44::DOUBLE - x * x, 0) for x in d]) END), 5) AS loss FROM la""",
)
_loss(
    "energy_margin",
    lambda s: losses.EnergyMarginLoss(0.4, eta=1.5, alarms=losses.Constraint(0.05, 0.3), fit=losses.Constraint(0.8, 0.2)).loss(s.e, "l", "y", weight=0.7, bias=-0.2),
    """, em AS (SELECT avg(CASE WHEN y >= 0 THEN 1 / (1 + exp(-(0.7::DOUBLE * lse - 0.2::DOUBLE))) END) - 0.05::DOUBLE AS a,
    avg(CASE WHEN y < 0 THEN 1 / (1 + exp(0.7::DOUBLE * (lse - 1.5::DOUBLE) - 0.2::DOUBLE)) END) AS b, avg(CASE WHEN y >= 0 THEN lse - l[y + 1] END) - 0.8::DOUBLE AS c FROM la)
SELECT round(CASE WHEN c + 0.2::DOUBLE >= 0 THEN c * 0.2::DOUBLE + c * c / 2 ELSE -0.02::DOUBLE END + b
    + CASE WHEN a + 0.3::DOUBLE >= 0 THEN a * 0.3::DOUBLE + a * a / 2 ELSE -0.045::DOUBLE END, 5) AS loss FROM em""",
)
