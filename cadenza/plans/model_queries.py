"""Queries of acoustic scoring: Gaussians per label over the embedding frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions.arrays import LOG10_E
from cadenza.operators import acoustic as A
from cadenza.operators import segment as V
from cadenza.plans.registry import CELLS, cells, frames, register, rounded

#: Gaussian scores in SQL: g(stream, t, id, g).
GAUSS = CELLS + f""", p AS (SELECT stream AS id, i, avg(x) AS m, greatest(var_pop(x), 1e-6) AS v FROM ce GROUP BY ALL),
k AS (SELECT id, count(*) * {np.log(2 * np.pi)} + sum(ln(v)) AS gconst FROM p GROUP BY id),
dd AS (SELECT stream, t, id, sum((x - m) * (x - m) / v) AS dist FROM ce JOIN p USING (i) GROUP BY ALL),
g AS (SELECT stream, t, id, -0.5 * (gconst + dist) AS g FROM dd JOIN k USING (id))"""
#: States 0 to 4: state s mixes Gaussians s (weight .7) and s + 5 (weight .3).
_MIX = f", j AS (SELECT stream, t, id % 5 AS state, g + ln(CASE WHEN id < 5 THEN 0.7 ELSE 0.3 END) AS v FROM g), sc AS (SELECT stream, t, state, (max(v) + ln(sum(exp(v - mx)))) * {LOG10_E} AS score FROM (SELECT *, max(v) OVER (PARTITION BY stream, t, state) AS mx FROM j) GROUP BY ALL)"


def _gauss(spark, d):
    f = frames(spark, d)
    return A.gaussian_scores(f, A.fit_gaussians(f, "stream"))


def _mixture(spark):
    rows = [(i % 5, 1, i // 5, i, float(np.log(0.7 if i < 5 else 0.3))) for i in range(10)]
    return spark.createDataFrame(rows, "state int, substream int, k int, id int, logw double")


def _scores(spark, d):
    return A.mixture_scores(_gauss(spark, d), _mixture(spark))


@register(f"WITH {GAUSS} SELECT stream, t, id, round(g, 5) + 0.0 AS g FROM g")
def gauss_score(spark, d):
    return _gauss(spark, d).withColumn("g", rounded("g", 5))


@register(f"WITH {GAUSS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream, t ORDER BY round(g, 9) DESC, id) AS rk FROM g) SELECT stream, t, id, round(g, 5) + 0.0 AS g, rk::INT AS rk FROM r WHERE rk <= 3")
def gauss_topk(spark, d):
    return A.top_gaussians(_gauss(spark, d), 3).withColumn("g", rounded("g", 5))


@register(f"WITH {GAUSS}{_MIX} SELECT stream, t, state, round(score, 5) + 0.0 AS score FROM sc")
def mixture_score(spark, d):
    return _scores(spark, d).withColumn("score", rounded("score", 5))


@register(f"""WITH {GAUSS}, r AS (SELECT *, id % 2 AS book, row_number() OVER (PARTITION BY stream, t, id % 2 ORDER BY g DESC, id) AS rk FROM g),
j AS (SELECT stream, t, state, g + ln((1.0 + (id + state) % 3) / 10) AS v FROM r, range(3) s(state) WHERE rk <= 2 AND (state < 2 AND book = state OR state = 2)),
m AS (SELECT *, max(v) OVER (PARTITION BY stream, t, state) AS mx FROM j)
SELECT stream, t, state::INT AS state, round((max(v) + ln(sum(exp(v - mx)))) * {LOG10_E}, 5) + 0.0 AS score FROM m GROUP BY ALL""")
def tied_mixture(spark, d):
    books = spark.createDataFrame([(i % 2, i) for i in range(10)], "book int, id int")
    weights = spark.createDataFrame([(s, i % 2, i, float(np.log((1.0 + (i + s) % 3) / 10))) for s in range(3) for i in range(10) if s == 2 or i % 2 == s], "state int, book int, id int, logw double")
    return A.tied_mixture_scores(_gauss(spark, d), books, weights, 2).withColumn("score", rounded("score", 5))


@register(f"""WITH {GAUSS}{_MIX}, c AS (SELECT stream, t, id AS sel, g * {LOG10_E} AS cheap, row_number() OVER (PARTITION BY stream, t ORDER BY g DESC, id) AS rk FROM g WHERE id < 5)
SELECT c.stream, c.t, state, rk <= 2 AS selected, round(CASE WHEN rk <= 2 THEN score ELSE cheap END, 5) + 0.0 AS score FROM c JOIN sc ON c.stream = sc.stream AND c.t = sc.t AND sel = state""")
def selection_fallback(spark, d):
    g = _gauss(spark, d)
    cheap = g.where("id < 5").select("stream", "t", F.col("id").alias("state"), (F.col("g") * LOG10_E).alias("score"))
    state_map = spark.createDataFrame([(s, s) for s in range(5)], "state int, select int")
    return A.selected_scores(cheap, _scores(spark, d), state_map, 2).withColumn("score", rounded("score", 5))


def _sets(spark):
    return spark.createDataFrame([("a", s) for s in (0, 1, 2, 3)] + [("b", s) for s in (2, 4)], "name string, state int")


@register(f"""WITH {GAUSS}{_MIX}, m AS (SELECT stream, t, name, score, row_number() OVER (PARTITION BY stream, t, name ORDER BY score DESC) AS rk FROM sc JOIN (VALUES ('a', 0), ('a', 1), ('a', 2), ('a', 3), ('b', 2), ('b', 4)) s(name, st) ON state = st)
SELECT stream, t, name, round(max(score), 5) + 0.0 AS top, round(avg(score), 5) + 0.0 AS mean, round(avg(score) FILTER (WHERE rk <= 3), 5) + 0.0 AS best FROM m GROUP BY ALL""")
def context_set_score(spark, d):
    s, sets = _scores(spark, d), _sets(spark)
    out = None
    for how, name in (("max", "top"), ("avg", "mean"), ("best", "best")):
        r = A.context_scores(s, sets, how).select("stream", "t", "name", rounded("score", 5).alias(name))
        out = r if out is None else out.join(r, ["stream", "t", "name"])
    return out


@register(f"WITH {CELLS} SELECT stream, t, s.state, round(coalesce(x, -1000000), 6) + 0.0 AS score FROM (SELECT DISTINCT stream, t FROM ce) f CROSS JOIN (VALUES (0), (63), (64)) s(state) LEFT JOIN ce USING (stream, t) WHERE ce.i = s.state OR (s.state = 64 AND ce.i = 0) AND true".replace("coalesce(x, -1000000)", "CASE WHEN s.state = 64 THEN -1000000 ELSE x END"))
def direct_score(spark, d):
    states = spark.createDataFrame([(0,), (63,), (64,)], "state int")
    return A.direct_scores(frames(spark, d), states).withColumn("score", rounded("score"))


_TOTALS = f"WITH {GAUSS}, tt AS (SELECT stream, 'm' || id AS model, sum(g) AS score, count(*) AS frames FROM g GROUP BY ALL), top AS (SELECT *, max(score) OVER (PARTITION BY stream) AS mx FROM tt)"


@register(_TOTALS + " SELECT stream, arg_max(model, score) AS model, round(max(score), 3) + 0.0 AS score, round(1 / sum(pow(10, 0.05 * (score - mx))), 6) + 0.0 AS confidence, NOT contains('m3,m7', arg_max(model, score)) AS accepted FROM top GROUP BY stream")
def gmm_decision(spark, d):
    g = _gauss(spark, d).select("stream", "t", F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), F.col("g").alias("score"))
    r = V.decide_model(V.model_totals(g), "m3,m7")
    return r.select("stream", "model", rounded("score", 3).alias("score"), rounded("confidence").alias("confidence"), "accepted")


@register(f"WITH {GAUSS}, b AS (SELECT *, max(g) OVER (PARTITION BY stream, t) AS top FROM g) SELECT stream, t, arg_max(id, g) AS label, round(max(g), 5) + 0.0 AS score, round(1 / sum(pow(10, 0.05 * (g - top))), 6) + 0.0 AS confidence FROM b GROUP BY stream, t")
def frame_classes(spark, d):
    """Flagship: the best Gaussian of every frame with its confidence."""
    s = _gauss(spark, d).groupBy("stream", "t").agg(F.collect_list(F.struct("g", (-F.col("id")).alias("n"))).alias("s"))  # a model's Gaussians
    best = F.array_max("s")
    z = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), 0.05 * (x["g"] - best["g"])))
    return s.select("stream", "t", (-best["n"]).alias("label"), rounded(best["g"], 5).alias("score"), rounded(1 / z).alias("confidence"))


@register()
def dnn_score(spark, d):
    rng = np.random.default_rng(1)
    shapes = [(64, 32), (32, 16), (16, 10)]
    layers = [(rng.normal(0, 0.3, (o, i)), rng.normal(0, 0.1, o)) for i, o in shapes]
    return cells(A.dnn_scores(frames(spark, d), layers, np.full(10, -1.0)), digits=5)
