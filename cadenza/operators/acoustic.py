"""Likelihood scoring of frames against model tables.

frames(stream, t, vec), gauss(id, mean, invvar, gconst), mix(state, substream, k, id, logw). Model tables are small and
fixed in size by the model; they are joined with a broadcast only below MODEL_ROWS, which is checked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.arrays import LOG10_E, LOG_ZERO, top_mean, vec

#: The selection width of cheap states, the N best of context sets, the logistic table's clamp.
SELECT, CONTEXT_BEST, LOGISTIC_RANGE, LOGISTIC_CLAMP = 24, 3, 8.0, (0.000334, 0.999666)
MODEL_ROWS = 100_000


def small(model: DataFrame) -> DataFrame:
    """The model table, to be broadcast where its row count is within bounds."""
    return F.broadcast(model) if model.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS else model


def fit_gaussians(frames: DataFrame, by: str = "label", floor: float = 1e-6) -> DataFrame:
    """One diagonal Gaussian per label: mean, inverse population variance, gconst = n ln 2 pi + sum ln var."""
    d = frames.select(by, F.posexplode(vec("vec")).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("v"))
    out = d.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("d"), F.sum(F.log("v")).alias("lv"))
    gconst = F.size("d") * float(np.log(2 * np.pi)) + F.col("lv")
    return out.select(F.col(by).alias("id"), F.transform("d", lambda s: s["m"]).alias("mean"), F.transform("d", lambda s: 1 / s["v"]).alias("invvar"), gconst.alias("gconst"))


#: Parts in which frames meet a model that is too large to be sent to every task.
PARTS = 256


def _with_model(frames: DataFrame, model: DataFrame, on) -> DataFrame:
    """Every frame with every row of the model that applies. A larger model than MODEL_ROWS is copied to each part of the
    frames, so that no task has all frames."""
    if model.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS:
        return frames.join(F.broadcast(model), on)
    dealt = frames.withColumn("_part", F.pmod(F.xxhash64("stream", "t"), F.lit(PARTS)))
    copies = model.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).cast("long"))
    return dealt.join(copies, (F.col("_part") == F.col("_of")) & on).drop("_part", "_of")


def gaussian_scores(frames: DataFrame, gauss: DataFrame) -> DataFrame:
    """(stream, t, id, g): -1/2 (gconst + sum (x - mean)^2 invvar). Gaussians of another length than the frame's valid
    dimensions do not apply (multi-space)."""
    g = _with_model(frames, gauss, F.size("vec") == F.size("mean"))
    d = F.zip_with("vec", "mean", lambda x, m: x - m)
    dist = F.aggregate(F.zip_with(d, "invvar", lambda x, v: x * x * v), F.lit(0.0), lambda a, x: a + x)
    return g.select("stream", "t", "id", (-0.5 * (F.col("gconst") + dist)).alias("g"))


def valid_dims(v, lzero: float = -1e10):
    """The dimensions that are not marked invalid."""
    return F.filter(v, lambda x: x > lzero)


def top_gaussians(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each frame with rk from 1 (ties: the smaller id); pruning without loss."""
    rk = F.row_number().over(Window.partitionBy("stream", "t").orderBy(F.desc("g"), "id"))
    return scores.withColumn("rk", rk).where(F.col("rk") <= k)


def mixture_scores(scores: DataFrame, mix: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """(stream, t, state, score) in log10: sum over substreams of weight times ln sum_k e^(g + ln w). A substream at or
    below LOG_ZERO is skipped; LOG_ZERO if all are."""
    j = scores.join(small(mix), "id").withColumn("v", F.col("g") + F.col("logw"))
    top = j.groupBy("stream", "t", "state", "substream").agg(F.max("v").alias("top"), F.collect_list("v").alias("vs"))  # at most a mixture's components
    lse = F.col("top") + F.log(F.aggregate(F.transform("vs", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v))
    s = top.withColumn("s", lse)
    w = F.lit(1.0)
    for k, x in (weights or {}).items():
        w = F.when(F.col("substream") == k, x).otherwise(w)
    part = F.when(F.col("s") > LOG_ZERO, w * F.col("s"))
    return s.groupBy("stream", "t", "state").agg(F.coalesce(F.sum(part) * LOG10_E, F.lit(LOG_ZERO)).alias("score"))


def tied_mixture_scores(scores: DataFrame, books: DataFrame, weights: DataFrame, keep: int) -> DataFrame:
    """Codebooks (book, id) are scored and pruned to `keep` once per frame, then shared by the states that weigh their
    entries (state, book, id, logw)."""
    entries = scores.join(small(books), "id")
    rk = F.row_number().over(Window.partitionBy("stream", "t", "book").orderBy(F.desc("g"), "id"))
    best = entries.withColumn("rk", rk).where(F.col("rk") <= keep)
    j = best.join(small(weights), ["book", "id"]).withColumn("v", F.col("g") + F.col("logw"))
    s = j.groupBy("stream", "t", "state").agg(F.max("v").alias("top"), F.collect_list("v").alias("vs"))
    lse = F.col("top") + F.log(F.aggregate(F.transform("vs", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v))
    return s.select("stream", "t", "state", (lse * LOG10_E).alias("score"))


def compound_scores(plain: DataFrame, tied: DataFrame) -> DataFrame:
    """States with own and states with tied mixtures together."""
    return plain.unionByName(tied)


def selected_scores(cheap: DataFrame, full: DataFrame, state_map: DataFrame, best: int = SELECT) -> DataFrame:
    """Of each frame the `best` cheap selection states get the full score of the states they stand for; the others keep
    the cheap score. state_map: (state, select)."""
    rk = F.row_number().over(Window.partitionBy("stream", "t").orderBy(F.desc("cheap"), "select"))
    ranked = cheap.select("stream", "t", F.col("state").alias("select"), F.col("score").alias("cheap")).withColumn("rk", rk)
    states = ranked.join(small(state_map), "select")
    j = states.join(full.select("stream", "t", "state", F.col("score").alias("full")), ["stream", "t", "state"], "left")
    use = F.col("rk") <= best
    return j.select("stream", "t", "state", F.when(use, F.coalesce("full", "cheap")).otherwise(F.col("cheap")).alias("score"), use.alias("selected"))


def context_scores(scores: DataFrame, sets: DataFrame, how: str = "best", n: int = CONTEXT_BEST) -> DataFrame:
    """(stream, t, name, score) of context sets (name, state): max, average or mean of the n best, LOG_ZERO left out."""
    j = scores.join(small(sets), "state").groupBy("stream", "t", "name").agg(F.collect_list("score").alias("s"))  # a set's states
    value = {"max": F.array_max("s"), "avg": top_mean("s", 1 << 30), "best": top_mean("s", n)}[how]
    return j.select("stream", "t", "name", F.coalesce(value, F.lit(LOG_ZERO)).alias("score"))


def direct_scores(frames: DataFrame, states: DataFrame) -> DataFrame:
    """The frame vector is the score; a state id beyond it gives LOG_ZERO."""
    n = F.size("vec")
    ids = sorted({r["state"] for r in states.select("state").distinct().limit(MODEL_ROWS + 1).collect()})  # a model's states
    if len(ids) > MODEL_ROWS:
        raise ValueError(f"more than {MODEL_ROWS} states")
    j = frames.select("stream", "t", "vec", F.explode(F.array(*map(F.lit, ids))).alias("state"))
    return j.select("stream", "t", "state", F.when((F.col("state") >= 0) & (F.col("state") < n), F.get("vec", F.col("state"))).otherwise(F.lit(LOG_ZERO)).alias("score"))


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^-x) within the range, constant beyond it."""
    y = 1 / (1 + np.exp(-np.clip(x, -LOGISTIC_RANGE, LOGISTIC_RANGE)))
    return np.where(x <= -LOGISTIC_RANGE, LOGISTIC_CLAMP[0], np.where(x >= LOGISTIC_RANGE, LOGISTIC_CLAMP[1], y))


def dnn_forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], log10_prior: np.ndarray) -> np.ndarray:
    """Hidden layers with the logistic, then log10 posteriors less log10 priors."""
    for w, b in layers[:-1]:
        x = logistic(x @ w.T + b)
    w, b = layers[-1]
    z = x @ w.T + b
    z = z - z.max(axis=1, keepdims=True)
    return LOG10_E * (z - np.log(np.exp(z).sum(axis=1, keepdims=True))) - log10_prior


def dnn_scores(frames: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], log10_prior: np.ndarray) -> DataFrame:
    """vec becomes the state scores of a network; Arrow batches, matrix products in numpy."""

    def kernel(batches):
        for pdf in batches:
            if not pdf.empty:
                pdf = pdf.copy()
                pdf["vec"] = list(dnn_forward(np.stack(pdf["vec"].to_numpy()).astype(float), layers, log10_prior))
            yield pdf

    kind = frames.schema["stream"].dataType.simpleString()
    return frames.select("stream", "t", "vec").mapInPandas(kernel, f"stream {kind}, t {frames.schema['t'].dataType.simpleString()}, vec array<double>")


def score(frames: DataFrame, config: dict) -> DataFrame:
    """Chooses how states are scored: `direct`, `dnn`, `tied` or `mixture`."""
    how = config.get("how", "mixture")
    if how == "direct":
        return direct_scores(frames, config["states"])
    if how == "dnn":
        return dnn_scores(frames, config["layers"], config["log10_prior"]).select("stream", "t", F.posexplode("vec").alias("state", "score"))
    g = gaussian_scores(frames, config["gauss"])
    if how == "tied":
        return tied_mixture_scores(g, config["books"], config["weights"], config["keep"])
    return mixture_scores(g, config["mix"], config.get("stream_weights"))


def needed_scores(needed: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the distinct (stream, t, state) that are asked for, each computed once."""
    return needed.select("stream", "t", "state").distinct().join(scores, ["stream", "t", "state"], "left").fillna(LOG_ZERO, ["score"])


def pruned_gaussians(x: np.ndarray, mean: np.ndarray, invvar: np.ndarray, gconst: np.ndarray, keep: int, last: list[int], slack: float | None = None) -> list[tuple[int, float]]:
    """Top Gaussians of a frame with per-dimension pruning: partial distances above those of last frame's best by
    `slack` end a Gaussian (approximate); without slack only those that cannot enter the best any more (exact)."""
    best: list[tuple[float, int]] = []
    partial = None
    order = [*last, *[k for k in range(len(mean)) if k not in set(last)]]
    for k in order:
        parts = np.cumsum((x - mean[k]) ** 2 * invvar[k]) + gconst[k]
        bound = np.inf if len(best) < keep else -2 * best[-1][0]
        if k not in last:
            if slack is not None and partial is not None and (parts > partial + slack).any():
                continue
            if parts[-1] > bound:
                continue
        elif slack is not None:
            partial = parts if partial is None else np.maximum(partial, parts)
        best = sorted([*best, (-0.5 * parts[-1], k)], key=lambda s: (-s[0], s[1]))[:keep]
    return [(k, s) for s, k in best]
