"""Dictionary and phone operators: words(wid, wname, woutput, phones, cprob, transparent, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SILENCES = ("silB", "silE", "sp")


def lookup(words: DataFrame, keyword: str) -> int | None:
    """Word id of `#id`, `name[output prefix]` or `name`; the first that matches."""
    if keyword.startswith("#"):
        cond = F.col("wid") == int(keyword[1:])
    elif "[" in keyword:
        name, out = keyword.rstrip("]").split("[", 1)
        cond = (F.col("wname") == name) & F.startswith("woutput", F.lit(out))
    else:
        cond = F.col("wname") == keyword
    return words.where(cond).agg(F.min("wid")).first()[0]


def sentence_ids(df: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, w, wid): the smallest id of each word of a text; null if there is none."""
    first = words.groupBy(F.col("wname").alias("w")).agg(F.min("wid").alias("wid"))
    tokens = df.select(key, F.posexplode(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")).alias("pos", "w"))
    return tokens.join(first, "w", "left").select(key, "pos", "w", "wid")


def triphones(phones: Column) -> Column:
    """l-p+r within a word; the parts that the word's edge lacks are left out."""
    n = F.size(phones)
    left = lambda i: F.when(i > 0, F.concat(F.get(phones, i - 1), F.lit("-"))).otherwise("")
    right = lambda i: F.when(i < n - 1, F.concat(F.lit("+"), F.get(phones, i + 1))).otherwise("")
    return F.transform(phones, lambda p, i: F.concat(left(i), p, right(i)))


def centre(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^[^-]*-", ""), r"\+.*$", "")


def left_centre(name: Column) -> Column:
    return F.regexp_replace(name, r"\+.*$", "")


def right_centre(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^-]*-", "")


def with_left(name: Column, left: Column) -> Column:
    return F.concat(left, F.lit("-"), right_centre(name))


def with_right(name: Column, right: Column) -> Column:
    return F.concat(left_centre(name), F.lit("+"), right)


def find_models(names: DataFrame, models: DataFrame, pseudo: DataFrame | None = None) -> DataFrame:
    """Logical names with their physical model, else the pseudo phone of their base, else null."""
    out = names.join(models.select("name", "model"), "name", "left")
    if pseudo is not None:
        base = names.select("name", right_centre(F.col("name")).alias("_r"), centre(F.col("name")).alias("_c"))
        p = pseudo.select(F.col("name").alias("_c"), F.lit(True).alias("_p")).distinct()
        out = out.join(base.join(p, "_c", "left").select("name", "_c", "_p"), "name", "left").withColumn("pseudo", F.when(F.col("model").isNull() & F.col("_p"), F.col("_c"))).drop("_c", "_p")
    return out


def pseudo_phones(states: DataFrame) -> DataFrame:
    """Context sets: for each base phone, left-centre and right-centre name, and state position the set of states of
    the models (name, pos, state) that share it."""
    names = F.array_distinct(F.array(centre(F.col("name")), left_centre(F.col("name")), right_centre(F.col("name"))))
    return states.select(F.explode(names).alias("set"), "pos", "state").groupBy("set", "pos").agg(F.array_sort(F.collect_set("state")).alias("states"))


def base_phones(words: DataFrame) -> DataFrame:
    """(phone, uses, begins, ends): how often each base phone occurs and whether words begin or end with it."""
    p = words.select("wid", F.size("phones").alias("n"), F.posexplode("phones").alias("i", "p"))
    return p.groupBy(centre(F.col("p")).alias("phone")).agg(F.count("*").alias("uses"), F.max(F.col("i") == 0).alias("begins"), F.max(F.col("i") == F.col("n") - 1).alias("ends"))


def missing_triphones(words: DataFrame, models: DataFrame) -> DataFrame:
    """Inter-word triphones that no model has: every word end (its last two phones) before every word beginning."""
    ends = words.where(F.size("phones") > 1).select(F.element_at("phones", -2).alias("l"), F.element_at("phones", -1).alias("c")).distinct()
    starts = words.select(F.element_at("phones", 1).alias("r")).distinct()
    # phones are a small alphabet: as many pairs as models can exist
    listed = starts.groupBy(F.lit(1).alias("k")).agg(F.collect_set("r").alias("rs"))
    all_ = ends.withColumn("k", F.lit(1)).join(listed, "k").select("l", "c", F.explode("rs").alias("r"))
    named = all_.select(F.concat(F.col("l"), F.lit("-"), F.col("c"), F.lit("+"), F.col("r")).alias("name"))
    return named.join(models.select("name"), "name", "left_anti")


def depends_on_context(names: DataFrame) -> bool:
    """Some name has a left and some name a right context."""
    r = names.agg(F.max(F.contains("name", F.lit("+"))).alias("p"), F.max(F.contains("name", F.lit("-"))).alias("m")).first()
    return bool(r.p and r.m)


def check_models(transitions: DataFrame) -> DataFrame:
    """Models (model, i, j, logp) that break the rules: no arc may enter the first state or leave the last, and each
    state's probabilities must sum to 1."""
    last = transitions.groupBy("model").agg(F.max("j").alias("last"))
    t = transitions.join(last, "model")
    shape = t.where((F.col("j") == 0) | (F.col("i") == F.col("last"))).select("model", F.lit("arc").alias("problem"))
    sums = t.groupBy("model", "i").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("s")).where(F.abs(F.col("s") - 1) > 1e-3).select("model", F.lit("sum").alias("problem"))
    return shape.unionByName(sums).distinct()


def append(words: DataFrame, more: DataFrame, word_offset: int, category_offset: int = 0) -> DataFrame:
    """Words with those of another dictionary, whose ids are moved behind."""
    moved = more.withColumn("wid", F.col("wid") + word_offset)
    if "cat" in more.columns:
        moved = moved.withColumn("cat", F.col("cat") + category_offset)
    return words.unionByName(moved, allowMissingColumns=True)


def statistics(words: DataFrame, states_a_phone: int = 3) -> DataFrame:
    """One row: words, longest word in phones, phones and states in all, transparent words."""
    return words.agg(F.count("*").alias("words"), F.max(F.size("phones")).alias("longest"), F.sum(F.size("phones")).alias("phones"), (F.sum(F.size("phones")) * states_a_phone).alias("states"), F.count_if("transparent").alias("transparent"))


def sentence_models(sentences: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, phones): the phone sequence of each sentence's words (key, pos, wid)."""
    j = sentences.join(words.select("wid", "phones"), "wid")
    return j.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phones"))), lambda s: s["phones"])).alias("phones"))
