"""Confidence, minimum Bayes risk and word distances of N-best sentences: nbest(stream, rank, score, words)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, MBR_WEIGHT, MBR_POWER = 0.05, 1.0, 1.0


def softmax10(score: Column, group: list[str], alpha: float | Column = ALPHA) -> Column:
    """10^(alpha (s - best)) over its sum within a group."""
    w = Window.partitionBy(*group)
    e = F.pow(F.lit(10.0), alpha * (score - F.max(score).over(w)))
    return e / F.sum(e).over(w)


def sentence_posteriors(nbest: DataFrame, alpha: float = ALPHA) -> DataFrame:
    top = nbest.groupBy("stream").agg(F.max("score").alias("_top"))
    e = nbest.join(top, "stream").withColumn("_e", F.pow(F.lit(10.0), alpha * (F.col("score") - F.col("_top"))))
    total = e.groupBy("stream").agg(F.sum("_e").alias("_z"))
    return e.join(total, "stream").withColumn("posterior", F.col("_e") / F.col("_z")).drop("_top", "_e", "_z")


def word_confidence(nbest: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(stream, word, confidence): posteriors summed over all sentences and all places that hold the word."""
    p = sentence_posteriors(nbest, alpha)
    return p.select("stream", "posterior", F.explode("words").alias("word")).groupBy("stream", "word").agg(F.sum("posterior").alias("confidence"))


def confidence_grid(nbest: DataFrame, alphas: list[float]) -> DataFrame:
    """Word confidences for several alphas at once."""
    g = nbest.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    w = Window.partitionBy("stream", "alpha")
    e = g.withColumn("_e", F.pow(F.lit(10.0), F.col("alpha") * (F.col("score") - F.max("score").over(w))))
    p = e.withColumn("posterior", F.col("_e") / F.sum("_e").over(w))
    return p.select("stream", "alpha", "posterior", F.explode("words").alias("word")).groupBy("stream", "alpha", "word").agg(F.sum("posterior").alias("confidence"))


def prune(confidence: DataFrame, least: float) -> DataFrame:
    return confidence.where(F.col("confidence") >= least)


#: Characters that stand for words where a pair has no more different words than these.
_FIRST_SYMBOL, _SYMBOLS = 0x3400, 0xD7FF - 0x3400


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: each different word of the pair becomes a character, and the built-in
    distance of strings does the rest."""
    known = F.array_distinct(F.concat(a, b))
    symbol = lambda w: F.decode(F.unhex(F.hex(F.lit(_FIRST_SYMBOL) + F.array_position(known, w))), "UTF-16BE")
    text = lambda x: F.array_join(F.transform(x, symbol), "")
    distance = F.levenshtein(text(a), text(b))
    return F.when(F.size(known) <= _SYMBOLS, distance).otherwise(F.raise_error(F.lit("more different words than symbols")).cast("int"))


def mbr(nbest: DataFrame, weight: float = MBR_WEIGHT, power: float = MBR_POWER, most: int | None = None) -> DataFrame:
    """risk = sum over sentences j of 10^((s_j - max) weight) distance(i, j)^power, ascending (ties: the old rank). The
    pairs are those of one stream's sentences, of the `most` best where that is given."""
    top = F.max("score").over(Window.partitionBy("stream"))
    nbest = nbest if most is None else nbest.where(F.col("rank") <= most)
    n = nbest.withColumn("_e", F.pow(F.lit(10.0), (F.col("score") - top) * weight))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, F.col("a.stream") == F.col("b.stream"))
    loss = F.pow(word_distance(F.col("a.words"), F.col("b.words")).cast("double"), F.lit(power))
    risk = pairs.select("a.stream", "a.rank", "a.score", "a.words", (F.col("b._e") * loss).alias("r")).groupBy("stream", "rank", "score", "words").agg(F.sum("r").alias("risk"))
    return risk.withColumn("mbr_rank", F.row_number().over(Window.partitionBy("stream").orderBy("risk", "rank")))


def weighted_distance(a: list[str], b: list[str], weight: dict[str, float], compat: bool = False) -> float:
    """Between words that both have in a best alignment, the larger of the weights left out on either side. With compat
    the test for equal sentences looks at the cell before the last row's end, as the classic code does."""
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    flat = [x for row in d for x in row]
    if (flat[max(0, n * m - 1)] if compat else d[n][m]) == 0:
        return 0.0
    i, j, anchors = n, m, []
    while i and j:
        if a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            anchors.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    total, pi, pj = 0.0, 0, 0
    for x, y in [*reversed(anchors), (n, m)]:
        total += max(sum(weight.get(w, 1.0) for w in a[pi:x]), sum(weight.get(w, 1.0) for w in b[pj:y]))
        pi, pj = x + 1, y + 1
    return total
