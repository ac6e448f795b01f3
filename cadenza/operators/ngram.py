"""N-gram language models by joins: table lookup with back-off and what builds on it.

A model is one table per order, ngram_k(w1..wk, logp, bow), log10. Tables are joined by key; Spark broadcasts a table
only where its size allows.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.arrays import LOG_ZERO
from cadenza.functions.shared import written

UNKNOWN = "<unk>"
#: The trellis look-up range in frames, the sentence length limit of generation.
LOOKUP_RANGE, MAX_WORDS = 5, 500
DISCOUNT = 0.5


# --- estimation (a fixture: the engine only reads models) ---------------------------------------------------------
def sentence_words(df: DataFrame, key: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """(key, pos, w) with <s> at 0 and </s> at the end."""
    words = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1), F.array(F.lit("</s>")))
    return df.select(key, F.posexplode(words).alias("pos", "w"))


def sentence_grams(df: DataFrame, key: str, text: str, n: int, pattern: str = "[a-z]+") -> DataFrame:
    """As grams() of sentence_words(), straight from the texts: no shuffle, as a text's words lie in one row."""
    words = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1), F.array(F.lit("</s>")))
    rows = df.select(key, words.alias("_w"))
    last = F.explode(F.filter(F.sequence(F.lit(n - 1), F.greatest(F.size("_w") - 1, F.lit(n - 1))), lambda i: i < F.size("_w")))
    at = rows.select(key, "_w", last.alias("pos"))
    return at.select(key, "pos", *[F.get("_w", F.col("pos") - (n - i)).alias(f"w{i}") for i in range(1, n + 1)])


def grams(words: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pos of the last word, w1..wn)."""
    w = Window.partitionBy(key).orderBy("pos")
    cols = [F.lag("w", n - i).over(w).alias(f"w{i}") for i in range(1, n)] + [F.col("w").alias(f"w{n}")]
    return words.select(key, "pos", *cols).where(" and ".join(f"w{i} is not null" for i in range(1, n + 1)))


def _counts(words: DataFrame, key: str, order: int, text: str | None) -> list[DataFrame]:
    """(w1..wn, c) for each order, from one pass over the texts: all orders are counted together and written once."""
    if text is None:
        rows = [grams(words, key, n) for n in range(1, order + 1)]
        w = lambda df, i, n: F.col(f"w{i}") if i <= n else F.lit(None).cast("string")
        every = None
        for n, df in enumerate(rows, 1):
            one = df.select(F.lit(n).alias("n"), *[w(df, i, n).alias(f"w{i}") for i in range(1, order + 1)])
            every = one if every is None else every.unionByName(one)
    else:
        ws = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), F.array(F.lit("</s>")))
        at = words.select(ws.alias("_w")).select("_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("i"))
        ends = at.select("_w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("i") + 1))).alias("n"))
        every = ends.select("n", *[F.when(F.col("n") >= k, F.get("_w", F.col("i") - F.col("n") + k)).alias(f"w{k}") for k in range(1, order + 1)])
    names = [f"w{i}" for i in range(1, order + 1)]
    c = written(every.where("not (n = 1 and w1 = '<s>')").groupBy("n", *names).agg(F.count("*").alias("c")), "counts")
    return [c.where(F.col("n") == n).select(*names[:n], "c") for n in range(1, order + 1)]


def estimate(words: DataFrame, key: str, order: int = 3, discount: float = DISCOUNT, min_count: int = 1, text: str | None = None) -> list[DataFrame]:
    """Absolute discounting; bow spreads the mass left over over the words that the context has not seen. words holds
    exploded words, or whole texts if `text` names their column. Counts and tables are written, so each is computed once
    however many look-ups follow."""
    counts = _counts(words, key, order, text)
    uni = counts[0]
    sized = uni.crossJoin(F.broadcast(uni.agg(F.sum("c").alias("n"))))  # one row
    tables = [sized.select("w1", "c", F.log10(F.col("c") / F.col("n")).alias("logp"))]
    for n in range(2, order + 1):
        ctx = [f"w{i}" for i in range(1, n)]
        c = counts[n - 1].where(F.col("c") >= min_count)
        low = tables[n - 2].select(*[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, n)], F.col("logp").alias("low"))
        # one row a context: its count, how many words follow it, and how likely these are without it
        j = c.join(low, [f"w{i}" for i in range(2, n + 1)], "left")
        t = written(j.groupBy(*ctx).agg(F.sum("c").alias("ct"), F.count("*").alias("kinds"), F.sum(F.pow(F.lit(10.0), "low")).alias("seen")), "contexts")
        mine = c.join(t.select(*ctx, "ct"), ctx).select(*ctx, f"w{n}", "c", F.log10((F.col("c") - discount) / F.col("ct")).alias("logp"))
        tables.append(written(mine, "grams") if n < order else mine)
        bow = t.select(*ctx, F.log10(F.greatest(discount * F.col("kinds") / F.col("ct"), F.lit(1e-12)) / F.greatest(1 - F.col("seen"), F.lit(1e-12))).alias("bow"))
        tables[n - 2] = written(tables[n - 2].join(bow, ctx, "left"), "model")
    if order > 1:
        tables[-1] = written(tables[-1], "model")
    return tables


# --- lookup -------------------------------------------------------------------------------------------------------
def backoff(queries: DataFrame, tables: list[DataFrame], n: int, out: str = "logp", unknown_words: int | None = None) -> DataFrame:
    """log10 P(w_n | w_1..w_n-1) for columns w1..wn: a hit gives its probability; else the weight of the context, 0 if
    the context or its weight is missing, plus the probability of the shorter context. Above the model's order it is
    LOG_ZERO. A unigram of the unknown word loses log10 of how many words it stands for."""
    if n > len(tables):
        return queries.withColumn(out, F.lit(LOG_ZERO))
    df, value = queries, None
    for k in range(1, n + 1):
        mine = [f"w{i}" for i in range(n - k + 1, n + 1)]
        hit = tables[k - 1].select(*[F.col(f"w{i + 1}").alias(m) for i, m in enumerate(mine)], F.col("logp").alias(f"_p{k}"))
        df = df.join(hit, mine, "left")
        if k == 1:
            value = F.coalesce(F.col("_p1"), F.lit(LOG_ZERO))
            if unknown_words:
                value = F.when(F.col(f"w{n}") == UNKNOWN, value - F.log10(F.lit(float(unknown_words)))).otherwise(value)
        else:
            ctx = mine[:-1]
            weight = tables[k - 2].select(*[F.col(f"w{i + 1}").alias(m) for i, m in enumerate(ctx)], F.col("bow").alias(f"_b{k}"))
            df = df.join(weight, ctx, "left")
            value = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) + value)
    return df.withColumn(out, value).drop(*[f"_p{k}" for k in range(1, n + 1)], *[f"_b{k}" for k in range(2, n + 1)])


def bigram(queries: DataFrame, tables: list[DataFrame], variant: str = "forward", reverse: list[DataFrame] | None = None) -> DataFrame:
    """log10 P(w2 | w1): from a forward model; or from a reverse model, whose entries are P(w1 | w2), by Bayes:
    P(w1|w2) + P(w2) - P(w1)."""
    if variant == "forward":
        return backoff(queries, tables, 2)
    swapped = queries.select(*[c for c in queries.columns if c not in ("w1", "w2")], F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    back = backoff(swapped, reverse, 2, "_r")
    back = back.select(*[c for c in back.columns if c not in ("w1", "w2")], F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    uni = reverse[0].select(F.col("w1").alias("u"), F.col("logp").alias("lp"))
    j = back.join(uni.select(F.col("u").alias("w1"), F.col("lp").alias("_u1")), "w1", "left").join(uni.select(F.col("u").alias("w2"), F.col("lp").alias("_u2")), "w2", "left")
    return j.withColumn("logp", F.col("_r") + F.coalesce("_u2", F.lit(LOG_ZERO)) - F.coalesce("_u1", F.lit(LOG_ZERO))).drop("_r", "_u1", "_u2")


def forward_to_back(words: DataFrame, key: str, tables: list[DataFrame], n: int) -> DataFrame:
    """For each position the score of w_1 in a backward search with a forward model: sum of P over the window that
    begins there less the sum over the window shifted by one; windows end with the sentence."""
    scored = None
    for k in range(1, n + 1):
        g = backoff(grams(words, key, k), tables, k).select(key, "pos", F.lit(k).alias("k"), "logp")
        scored = g if scored is None else scored.unionByName(g)
    p = scored.withColumn("start", F.col("pos") - F.col("k") + 1)
    full = p.groupBy(key, "start").agg(F.sum("logp").alias("s"), F.max("k").alias("k"))
    shifted = p.where(F.col("k") < n).groupBy(key, F.col("start")).agg(F.sum("logp").alias("r"))
    return full.join(shifted.withColumn("start", F.col("start") - 1), [key, "start"], "left").select(key, F.col("start").alias("pos"), (F.col("s") - F.coalesce("r", F.lit(0.0))).alias("score"))


def map_unknown(words: DataFrame, vocabulary: DataFrame, column: str = "w") -> DataFrame:
    """Words that the model lacks become <unk>, with oov marking them."""
    v = vocabulary.select(F.col("w1").alias(column)).distinct().withColumn("_known", F.lit(True))
    j = words.join(v, column, "left")
    return j.withColumn("oov", F.col("_known").isNull()).withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(UNKNOWN)).drop("_known")


def unknown_name(vocabulary: DataFrame, named: str | None = None) -> str | None:
    """The model's word for unknown words: the one named, else <unk> or <UNK> if it is there."""
    names = [r[0] for r in vocabulary.where(F.col("w1").isin(*([named] if named else ["<unk>", "<UNK>"]))).select("w1").distinct().collect()]
    return next((n for n in ("<unk>", "<UNK>", named) if n in names), None)


def repair_unigrams(uni: DataFrame, begin: str = "<s>", end: str = "</s>") -> DataFrame:
    """A begin word of probability -99 takes that of the end word."""
    last = uni.where(F.col("w1") == end).agg(F.max("logp").alias("_e"))
    return uni.crossJoin(F.broadcast(last)).withColumn("logp", F.when((F.col("w1") == begin) & (F.col("logp") <= -99), F.col("_e")).otherwise(F.col("logp"))).drop("_e")


def class_scores(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the log class probability of each word (w, cprob) to its class's score."""
    return scored.join(words.select("w", "cprob"), "w", "left").withColumn("logp", F.col("logp") + F.coalesce("cprob", F.lit(0.0))).drop("cprob")


def scaled(logp, weight: float, penalty: float, transparent=None, transparent_penalty: float = 0.0):
    """score weight + penalty; a transparent word's own penalty is added."""
    out = logp * weight + penalty
    return out if transparent is None else out + F.when(transparent, transparent_penalty).otherwise(0.0)


def context_words(words: DataFrame, key: str, n: int) -> DataFrame:
    """For each word the last n - 1 words before it that are not transparent, oldest first."""
    solid = words.withColumn("_solid", F.when(~F.col("transparent"), F.col("w")))
    back = [F.expr(f"lag(_solid, {k}) ignore nulls over (partition by {key} order by pos)") for k in range(n - 1, 0, -1)]
    out = solid.withColumn("context", F.filter(F.array(*back), lambda x: x.isNotNull()) if n > 1 else F.array().cast("array<string>"))
    return out.drop("_solid")


def perplexity(words: DataFrame, key: str, tables: list[DataFrame], n: int) -> DataFrame:
    """Per key: words, unknown words, log10 probability, perplexity over the words after <s>."""
    known = map_unknown(words.where("pos > 0"), tables[0]).unionByName(words.where("pos = 0").withColumn("oov", F.lit(False)))
    parts = None
    for k in range(2, n + 1):
        g = backoff(grams(known, key, k), tables, k).where(F.col("pos") == k - 1 if k < n else F.col("pos") >= n - 1)
        g = g.select(key, "pos", "logp", F.col(f"w{k}").alias("w"))
        parts = g if parts is None else parts.unionByName(g)
    out = parts.groupBy(key).agg(F.count("*").alias("words"), F.count_if(F.col("w") == UNKNOWN).alias("oov"), F.sum(F.when(F.col("w") != UNKNOWN, F.col("logp"))).alias("logp"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("logp") / (F.col("words") - F.col("oov"))))


# --- search support -----------------------------------------------------------------------------------------------
def trellis_words(hypotheses: DataFrame, trellis: DataFrame, reach: int = LOOKUP_RANGE) -> DataFrame:
    """Words of the trellis (stream, wid, end_t, backscore) that end within `reach` frames of a hypothesis's estimated
    frame (stream, hyp, t0), nearest of each word (ties: the earlier). Frames are cut into bands of the reach, so the
    join has equal keys and no task holds a whole stream."""
    h = hypotheses.withColumn("band", F.explode(F.array(*[F.floor(F.col("t0") / reach) + i for i in (-1, 0, 1)])))
    j = h.join(trellis.withColumn("band", F.floor(F.col("end_t") / reach)), ["stream", "band"]).where(F.abs(F.col("end_t") - F.col("t0")) < reach)
    best = F.row_number().over(Window.partitionBy("stream", "hyp", "wid").orderBy(F.abs(F.col("end_t") - F.col("t0")), "end_t"))
    return j.withColumn("_k", best).where("_k = 1").drop("_k", "band")


def limit_next(candidates: DataFrame) -> DataFrame:
    """Candidates (last, last_end, w, end_t): nothing after <s>, no </s>, not the same trellis word again."""
    return candidates.where("last != '<s>' and w != '</s>' and not (w = last and end_t = last_end)")


def acceptable(hypotheses: DataFrame, head: str = "<s>", expected: dict | None = None) -> DataFrame:
    """accepted: the last word is the head silence, or in segments the expected end word."""
    want = F.lit(head)
    for stream, word in (expected or {}).items():
        want = F.when(F.col("stream") == stream, word).otherwise(want)
    return hypotheses.withColumn("accepted", F.col("last") == want)


def factoring(words: DataFrame, uni: DataFrame) -> DataFrame:
    """Maximum unigram score below each node of the phone-prefix tree: words (w, phones), uni (w1, logp)."""
    depths = words.join(uni.select(F.col("w1").alias("w"), "logp"), "w").select("w", "logp", "phones", F.explode(F.sequence(F.lit(1), F.size("phones"))).alias("_i"))
    nodes = depths.select("logp", F.array_join(F.slice("phones", F.lit(1), F.col("_i")), " ").alias("node"))  # row by row: a long word's prefixes never meet in one array
    return nodes.groupBy("node").agg(F.max("logp").alias("factor"), F.count("*").alias("words"))


def context_factoring(words: DataFrame, bi: DataFrame) -> DataFrame:
    """(last, node, factor): maximum bigram score below each node given the last word; bi: (w1, w2, logp)."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("phones")), lambda i: F.array_join(F.slice("phones", 1, i), " ")))
    return words.join(bi.select(F.col("w1").alias("last"), F.col("w2").alias("w"), "logp"), "w").select("last", "logp", prefix.alias("node")).groupBy("last", "node").agg(F.max("logp").alias("factor"))


def can_follow(nodes: DataFrame, node_words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes (last, node) from which some word (node, cat) may follow the last word's category: pairs (c1, c2)."""
    j = nodes.join(node_words, "node")
    return j.join(pairs.select(F.col("c1").alias("last_cat"), F.col("c2").alias("cat")), ["last_cat", "cat"], "left_semi").select("last", "node").distinct()


def generate(prob, vocabulary: list[str], seed: int, ignore: frozenset = frozenset(), begin: str = "<s>", end: str = "</s>", most: int = MAX_WORDS) -> list[str]:
    """A random sentence: words in order of probability, a cumulative draw; words to ignore are passed over. prob(ctx,
    w) is a probability. The same seed gives the same sentence."""
    rng, out = random.Random(seed), [begin]
    while out[-1] != end and len(out) < most:
        ranked = sorted(((prob(out, w), w) for w in vocabulary if w not in ignore and w != begin), key=lambda x: (-x[0], x[1]))
        draw, at = rng.random() * sum(p for p, _ in ranked), 0.0
        pick = ranked[-1][1]
        for p, w in ranked:
            at += p
            if draw < at:
                pick = w
                break
        out.append(pick)
    return out


def with_user_scores(queries: DataFrame, function) -> DataFrame:
    """logp from a user's function of the columns w1..wn: any expression or UDF that gives a column."""
    return queries.withColumn("logp", function(*[F.col(c) for c in queries.columns if c.startswith("w")]))
