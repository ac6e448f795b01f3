"""Queries of the remaining operators: over the supplied tables where these can play the part, else over small inline
models. Formats are written and read back, so that the result must be what went in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.functions.shared import fresh_path
from cadenza.operators import acoustic as A
from cadenza.operators import dictionary as D
from cadenza.operators import grammar as G
from cadenza.operators import lattice as W
from cadenza.operators import ngram as L
from cadenza.operators import rescore as R
from cadenza.operators import viterbi as B
from cadenza.plans import config as Z
from cadenza.plans.language_queries import _AUTOMATON, _CONV, _DICT, _SCORED_BI, MODEL, _arcs, _conversation_grams, _conversation_words, _dictionary, _model
from cadenza.plans.registry import FRAMES, ORACLES, STREAMS, frames, register, rounded, streams, table
from cadenza.plans.search_queries import LATTICE, NBEST, TRELLIS, _lattice, _nbest, _trellis
from cadenza.sources import readers, sinks
from cadenza.streaming import live


# --- language models ----------------------------------------------------------------------------------------------
@register(f"WITH {MODEL} SELECT w1, round(p, 6) + 0.0 AS logp FROM p1 UNION ALL SELECT '<s>', round(p, 6) + 0.0 FROM p1 WHERE w1 = '</s>'")
def unigram_repair(spark, d):
    uni = _model(spark, d, 1)[0].select("w1", "logp")
    uni = uni.unionByName(uni.where("w1 = '</s>'").select(F.lit("<s>").alias("w1"), F.lit(-99.0).alias("logp")))
    return L.repair_unigrams(uni).select("w1", rounded("logp").alias("logp"))


@register("SELECT * FROM (VALUES ('both', '<unk>'), ('named', 'X'), ('none', NULL), ('upper', '<UNK>')) t(model, name)")
def unknown_word(spark, d):
    v = lambda *w: spark.createDataFrame([(x,) for x in w], "w1 string")
    found = [("both", L.unknown_name(v("a", "<UNK>", "<unk>"))), ("upper", L.unknown_name(v("a", "<UNK>"))), ("named", L.unknown_name(v("a", "X"), "X")), ("none", L.unknown_name(v("a")))]
    return spark.createDataFrame(found, "model string, name string")


@register(f"WITH {MODEL}, {_CONV}, {_SCORED_BI} SELECT sid, pos, w2, round(p - CASE WHEN w2 IN (SELECT w1 FROM p1 WHERE c % 2 = 0) THEN len(w2) / 10.0 ELSE 0 END, 5) + 0.0 AS logp FROM sb")
def class_ngram(spark, d):
    t = _model(spark, d, 2)
    words = t[0].where("c % 2 = 0").select(F.col("w1").alias("w"), (-F.length("w1") / 10).alias("cprob"))
    scored = L.bigram(_conversation_grams(spark, d, 2), t).select("sid", "pos", F.col("w2").alias("w"), "logp")
    return L.class_scores(scored, words).select("sid", "pos", F.col("w").alias("w2"), rounded("logp", 5).alias("logp"))


@register(f"WITH {_CONV} SELECT sid, pos, w1, w2, -0.5::DOUBLE * len(w1) - 0.25::DOUBLE * len(w2) AS logp FROM cb")
def user_language_scores(spark, d):
    return L.with_user_scores(_conversation_grams(spark, d, 2), lambda a, b: (-0.5 * F.length(a) - 0.25 * F.length(b)).cast("double")).select("sid", "pos", "w1", "w2", rounded("logp").alias("logp"))


@register(f"WITH {_CONV} SELECT sid, pos, w1 AS last, w2 AS w FROM cb WHERE w1 <> '<s>' AND w2 <> '</s>' AND NOT (w1 = w2 AND pos % 2 = 0)")
def next_word_limit(spark, d):
    c = _conversation_grams(spark, d, 2).select("sid", "pos", F.col("w1").alias("last"), F.lit(0).alias("last_end"), F.col("w2").alias("w"), (F.col("pos") % 2).alias("end_t"))
    return L.limit_next(c).select("sid", "pos", "last", "w")


@register(f"WITH {_CONV} SELECT sid AS stream, pos, w AS last, w = CASE WHEN sid = 2000000 THEN 'the' ELSE '<s>' END AS accepted FROM cw WHERE pos < 4")
def ngram_acceptable(spark, d):
    h = _conversation_words(spark, d).where("pos < 4").select(F.col("sid").alias("stream"), "pos", F.col("w").alias("last"))
    return L.acceptable(h, expected={2_000_000: "the"}).select("stream", "pos", "last", "accepted")


@register(f"WITH {MODEL}, x AS (SELECT p2.w1 AS last, array_to_string(string_split(w2[1:k], ''), ' ') AS node, p FROM p2, range(1, 1000) r(k) WHERE k <= len(w2) AND w2 <> '</s>' AND c > 1) SELECT last, node, round(max(p), 6) + 0.0 AS factor FROM x GROUP BY ALL")
def context_factoring(spark, d):
    bi = _model(spark, d, 2)[1].where("c > 1 and w2 != '</s>'")
    return L.context_factoring(_dictionary(spark, d), bi).select("last", "node", rounded("factor").alias("factor"))


@register(f"WITH {_AUTOMATON}, n AS (SELECT DISTINCT l_linenumber AS last, (l_suppkey % 8)::INT AS last_cat, l_partkey % 5 AS node FROM lineitem), w AS (SELECT DISTINCT l_partkey % 5 AS node, (l_orderkey % 8)::INT AS cat FROM lineitem), pr2 AS (SELECT DISTINCT b.label AS c1, a.label AS c2 FROM arcs a JOIN arcs b ON a.dst = b.src WHERE a.label < b.label) SELECT DISTINCT last, n.node FROM n JOIN w USING (node) JOIN pr2 ON c1 = last_cat AND c2 = cat")
def can_follow(spark, d):
    line = table(spark, d, "lineitem")
    n = line.select(F.col("l_linenumber").alias("last"), (F.col("l_suppkey") % 8).cast("int").alias("last_cat"), (F.col("l_partkey") % 5).alias("node")).distinct()
    w = line.select((F.col("l_partkey") % 5).alias("node"), (F.col("l_orderkey") % 8).cast("int").alias("cat")).distinct()
    return L.can_follow(n, w, G.category_pairs(_arcs(spark, d)).where("c2 < c1"))


@register(f"WITH {MODEL}, g AS (SELECT w1, NULL AS w2, p, b FROM p1 LEFT JOIN b1 USING (w1) UNION ALL SELECT w1, w2, p, NULL FROM p2) SELECT w1, w2, printf('%.6f', p) AS logp, printf('%.6f', b) AS bow FROM g")
def arpa_round_trip(spark, d):
    """A model written as text and read again."""
    t = _model(spark, d, 2)
    path = fresh_path(spark, "arpa")
    sinks.write_arpa(t, path)
    one, two = readers.read_arpa(spark, path)
    out = one.select("w1", F.lit(None).cast("string").alias("w2"), "logp", "bow").unionByName(two.select("w1", "w2", "logp", F.lit(None).cast("double").alias("bow")))
    return out.select("w1", "w2", F.format_string("%.6f", "logp").alias("logp"), F.when(F.col("bow").isNotNull(), F.format_string("%.6f", "bow")).alias("bow"))


# --- dictionaries -------------------------------------------------------------------------------------------------
_ENTRIES = [
    "<s> [] silB", "</s> [] silE", "apple [Apple] ae p l", "apple [APPLE] ey p l", "pear @-0.5 [Pear] p eh r", "hush {quiet} :1.5 hh ah sh", "plain p l ey n", "pause [] sp",
]


def _words(spark):
    w = readers.parse_dictionary(spark.createDataFrame([(x,) for x in _ENTRIES], "value string"))
    order = {x.split()[0]: i for i, x in enumerate(_ENTRIES)}
    return w.withColumn("wid", F.create_map(*[y for k, v in order.items() for y in (F.lit(k), F.lit(v))])[F.col("wname")] - F.when(F.col("woutput") == "Apple", 1).otherwise(0))


_WORDS = """dwords AS (SELECT * FROM (VALUES (0, '<s>', '', 'silB', 0.0::DOUBLE, false, 1.0::DOUBLE), (1, '</s>', '', 'silE', 0.0, false, 1.0), (2, 'apple', 'Apple', 'ae p l', 0.0, false, 1.0), (3, 'apple', 'APPLE', 'ey p l', 0.0, false, 1.0),
(4, 'pear', 'Pear', 'p eh r', -0.5, false, 1.0), (5, 'hush', 'quiet', 'hh ah sh', 0.0, true, 1.5), (6, 'plain', 'plain', 'p l ey n', 0.0, false, 1.0), (7, 'pause', '', 'sp', 0.0, false, 1.0)) t(wid, wname, woutput, phones, cprob, transparent, weight))"""


@register(f"WITH {_WORDS} SELECT * FROM dwords")
def dictionary_entries(spark, d):
    return _words(spark).select("wid", "wname", "woutput", F.array_join("phones", " ").alias("phones"), "cprob", "transparent", "weight")


@register("SELECT * FROM (VALUES ('yes', 'yes', 'silB y eh s silE'), ('no', 'NO', 'silB n ow silE')) t(wname, woutput, phones)")
def word_list_entries(spark, d):
    w = readers.parse_word_list(spark.createDataFrame([("yes y eh s",), ("no [NO] n ow",)], "value string"))
    return w.select("wname", "woutput", F.array_join("phones", " ").alias("phones"))


@register(f"WITH {_WORDS}, k AS (SELECT * FROM (VALUES ('#6', 6, NULL, NULL), ('apple', NULL, 'apple', NULL), ('apple[APP]', NULL, 'apple', 'APP'), ('nothing', NULL, 'nothing', NULL)) t(keyword, id, name, out)) SELECT keyword, min(wid)::INT AS wid FROM k LEFT JOIN dwords ON wid = id OR (wname = name AND (out IS NULL OR starts_with(woutput, out))) GROUP BY keyword")
def dictionary_lookup(spark, d):
    w = _words(spark)
    return spark.createDataFrame([(k, D.lookup(w, k)) for k in ("#6", "apple", "apple[APP]", "nothing")], "keyword string, wid int")


@register(f"WITH {_WORDS} SELECT wid, wname, phones FROM dwords UNION ALL SELECT wid + 8, wname, phones FROM dwords WHERE wid > 1")
def dictionary_append(spark, d):
    w = _words(spark).select("wid", "wname", F.array_join("phones", " ").alias("phones"))
    return D.append(w, w.where("wid > 1"), 8)


@register(f"WITH {_DICT}, n AS (SELECT DISTINCT CASE WHEN i > 1 THEN phones[i - 1] || '-' ELSE '' END || phones[i] || CASE WHEN i < len(phones) THEN '+' || phones[i + 1] ELSE '' END AS name FROM dw, range(1, 300) r(i) WHERE i <= len(phones)), p AS (SELECT name, CASE WHEN contains(name, '-') THEN split_part(name, '-', 2) ELSE name END AS rc, split_part(name, '+', 1) AS lc FROM n) SELECT name, split_part(rc, '+', 1) AS centre, lc AS left_centre, rc AS right_centre, 'x-' || rc AS with_left, lc || '+y' AS with_right FROM p")
def context_names(spark, d):
    n = _dictionary(spark, d).select(F.explode(D.triphones(F.col("phones"))).alias("name")).distinct()
    c = F.col("name")
    return n.select("name", D.centre(c).alias("centre"), D.left_centre(c).alias("left_centre"), D.right_centre(c).alias("right_centre"), D.with_left(c, F.lit("x")).alias("with_left"), D.with_right(c, F.lit("y")).alias("with_right"))


@register(f"WITH {_DICT}, n AS (SELECT DISTINCT phones[i] || '+' || phones[i + 1] AS name, phones[i] AS c FROM dw, range(1, 300) r(i) WHERE i < len(phones)) SELECT name, CASE WHEN c < 'm' THEN 'model_' || c END AS model, CASE WHEN c >= 'm' AND c < 't' THEN c END AS pseudo FROM n")
def model_lookup(spark, d):
    p = _dictionary(spark, d).select("phones", F.explode(F.sequence(F.lit(0), F.size("phones") - 1)).alias("i"))
    n = p.where("i < size(phones) - 1").select(F.concat(F.get("phones", F.col("i")), F.lit("+"), F.get("phones", F.col("i") + 1)).alias("name")).distinct()
    models = n.where("name < 'm'").select("name", F.concat(F.lit("model_"), F.substring("name", 1, 1)).alias("model"))
    pseudo = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrs"], "name string")
    return D.find_models(n, models, pseudo).select("name", "model", "pseudo")


@register("SELECT * FROM (VALUES ('good', 'none'), ('into', 'arc'), ('loose', 'sum')) t(model, problem)")
def model_check(spark, d):
    h, q = float(np.log10(0.5)), float(np.log10(0.25))
    t = [("good", 0, 1, 0.0), ("good", 1, 1, h), ("good", 1, 2, h), ("into", 0, 1, 0.0), ("into", 1, 0, h), ("into", 1, 2, h), ("loose", 0, 1, 0.0), ("loose", 1, 1, q), ("loose", 1, 2, h)]
    m = spark.createDataFrame(t, "model string, i int, j int, logp double")
    return m.select("model").distinct().join(D.check_models(m), "model", "left").select("model", F.coalesce("problem", F.lit("none")).alias("problem"))


@register("SELECT 'words' AS names, true AS depends UNION ALL SELECT 'phones', false UNION ALL SELECT 'left', false")
def context_dependency(spark, d):
    n = lambda *x: spark.createDataFrame([(y,) for y in x], "name string")
    found = [("words", D.depends_on_context(n("a+b", "a-b"))), ("phones", D.depends_on_context(n("a", "b"))), ("left", D.depends_on_context(n("a-b", "c")))]
    return spark.createDataFrame(found, "names string, depends boolean")


@register(f"WITH {_DICT}, t AS (SELECT item_id, i, ws[i] AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), range(1, 2000) r(i) WHERE i <= len(ws)) SELECT item_id, string_agg(array_to_string(phones, ' '), ' ' ORDER BY i) AS phones FROM t JOIN dw USING (w) GROUP BY item_id")
def sentence_phones(spark, d):
    words = _dictionary(spark, d)
    b = table(spark, d, "benchmark").select("item_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), " ").alias("text"))
    return D.sentence_models(D.sentence_ids(b, words, "item_id", "text"), words, "item_id").select("item_id", F.array_join("phones", " ").alias("phones"))


# --- grammars -----------------------------------------------------------------------------------------------------
_FLAGS = [(0, False), (1, False), (2, True), (3, True)]


@register("SELECT l_orderkey AS hyp, l_linenumber AS state, l_linenumber IN (2, 3) AS accept FROM lineitem")
def state_acceptable(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyp"), F.col("l_linenumber").alias("state"))
    return G.acceptable(s, spark.createDataFrame(_FLAGS, "id int, accept boolean")).select("hyp", "state", "accept")


@register(f"WITH {_AUTOMATON} SELECT DISTINCT 'begin' AS place, label AS cat FROM arcs WHERE dst IN (2, 3) UNION SELECT 'end', label FROM arcs WHERE src = 0")
def edge_categories(spark, d):
    a = _arcs(spark, d)
    b = G.begin_categories(a, spark.createDataFrame(_FLAGS, "id int, accept boolean"))
    return b.select(F.lit("begin").alias("place"), "cat").unionByName(G.end_categories(a).select(F.lit("end").alias("place"), "cat")).distinct()


@register(f"WITH {_WORDS} SELECT DISTINCT wid % 3 AS cat FROM dwords WHERE phones = 'sp'")
def pause_categories(spark, d):
    w = _words(spark)
    return G.pause_categories(w.select((F.col("wid") % 3).alias("cat"), "wid"), w)


@register("SELECT l_orderkey AS wid, CASE WHEN l_orderkey % 30 < 10 THEN 'first' WHEN l_orderkey % 30 < 24 THEN 'second' END AS gram FROM lineitem")
def grammar_owner(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("wid"), (F.col("l_orderkey") % 30).alias("_w"))
    return G.owner(ids, [("first", 0, 10), ("second", 10, 24)], "_w").drop("_w")


@register(f"WITH RECURSIVE {_AUTOMATON}, sq AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY n) AS k, c * 4 + p AS label FROM ln), r AS (SELECT DISTINCT o, 0::BIGINT AS k, 0 AS state FROM sq UNION SELECT r.o, sq.k, arcs.dst FROM r JOIN sq ON sq.o = r.o AND sq.k = r.k + 1 JOIN arcs ON arcs.src = r.state AND arcs.label = sq.label), l AS (SELECT o, max(k) AS l FROM sq GROUP BY o) SELECT DISTINCT l.o AS l_orderkey, arcs.label AS cat FROM l JOIN r ON r.o = l.o AND r.k = l.l JOIN arcs ON arcs.src = r.state")
def following_categories(spark, d):
    line = table(spark, d, "lineitem")
    c = F.when(F.col("l_linestatus") == "F", 0).otherwise(1) * 4 + F.col("l_partkey") % 4
    s = line.select("l_orderkey", F.col("l_linenumber").alias("pos"), F.array(c.cast("int")).alias("cats"))
    reached = G.accept(s, _arcs(spark, d), spark.createDataFrame(_FLAGS, "id int, accept boolean"), "l_orderkey")
    return G.following_categories(reached.select("l_orderkey", "reached"), _arcs(spark, d), "l_orderkey")


def _language(spark, arcs, accept, most=4):
    """Sentences (read from the first word) that an automaton accepts, up to a length."""
    out, front = [], [((), 0)]
    for _ in range(most + 1):
        out += [s for s, q in front if accept.get(q)]
        front = [((c, *s), t) for s, q in front for (p, c, t) in arcs if p == q]
    return spark.createDataFrame([(" ".join(map(str, s)),) for s in sorted(set(out))], "sentence string")


@register("""WITH RECURSIVE a(src, label, dst) AS (VALUES (0, 0, 1), (0, 0, 2), (1, 1, 3), (2, 2, 3), (3, 0, 3)), w(s, q, n) AS (SELECT '', 0, 0 UNION ALL SELECT label || ' ' || s, dst, n + 1 FROM w JOIN a ON src = q WHERE n < 4)
SELECT DISTINCT trim(s) AS sentence FROM w WHERE q = 3""")
def determinised_language(spark, d):
    """What a determinised and minimised automaton accepts is what the automaton accepts."""
    return _language(spark, *G.minimise(*G.determinise([(0, 0, 1), (0, 0, 2), (1, 1, 3), (2, 2, 3), (3, 0, 3)], {3})))


@register("SELECT * FROM (VALUES ('GIVE FRUIT'), ('TAKE FRUIT'), ('GIVE FRUIT PLEASE'), ('TAKE FRUIT PLEASE'), ('GIVE A FRUIT'), ('TAKE A FRUIT'), ('GIVE A FRUIT PLEASE'), ('TAKE A FRUIT PLEASE')) t(sentence)")
def compiled_grammar(spark, d):
    arcs, accept, names = G.compile_grammar("S : VERB OBJ\nS : VERB OBJ PLEASE\nVERB : GIVE\nVERB : TAKE\nOBJ : FRUIT\nOBJ : A FRUIT")
    s = _language(spark, arcs, accept, 5)
    back = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(str(i)), F.lit(n))])
    return s.select(F.array_join(F.transform(F.split("sentence", " "), lambda c: back[c]), " ").alias("sentence"))


@register("""WITH RECURSIVE a(src, label, dst) AS (VALUES (0, 5, 1), (1, 6, 1), (1, 7, 2)), w(s, q, n) AS (SELECT '', 0, 0 UNION ALL SELECT s || ' ' || label, dst, n + 1 FROM w JOIN a ON src = q WHERE n < 4)
SELECT DISTINCT trim(s) AS sentence FROM w WHERE q = 2""")
def reversed_language(spark, d):
    """The automaton turned round reads the same sentences from the other end."""
    return _language(spark, *G.reversed_automaton([(0, 5, 1), (1, 6, 1), (1, 7, 2)], {0: False, 1: False, 2: True}))


@register("SELECT * FROM (VALUES ('added', 1, '0:a:true,1:b:true'), ('deactivated', 1, '0:a:true,1:b:false'), ('deleted', 2, '1:b:false'), ('words', 3, '1:b:false')) t(step, version, grammars)")
def grammar_lifecycle(spark, d):
    g, steps = G.GrammarSet(), []

    def note(step):
        g.update()
        steps.append((step, g.version, ",".join(f"{i}:{x['name']}:{str(x['active']).lower()}" for i, x in sorted(g.live.items()))))

    a, b = g.add("a", [], {}, []), g.add("b", [], {}, [])
    note("added")
    g.request("deactivate", b)
    note("deactivated")
    g.request("delete", a)
    note("deleted")
    g.add_words(b, [(0, 1)])
    note("words")
    return spark.createDataFrame(steps, "step string, version int, grammars string")


# --- search -------------------------------------------------------------------------------------------------------
@register("SELECT n AS words, greatest(200, least(1500, floor(15 * sqrt(n))))::INT AS width FROM (VALUES (10), (400), (5000), (60000)) t(n)")
def beam_widths(spark, d):
    return spark.createDataFrame([(n, B.beam_width(1500, n)) for n in (10, 400, 5000, 60000)], "words int, width int")


@register(f"WITH {MODEL} SELECT w1, round(p, 6) + 0.0 AS logp FROM p1 ORDER BY p DESC, w1 LIMIT 25")
def frequent_words(spark, d):
    return B.frequent_words(_model(spark, d, 1)[0], 25).select("w1", rounded("logp").alias("logp"))


@register(f"WITH {TRELLIS}, l AS (SELECT stream, max(end_t) AS end_t FROM tr GROUP BY stream), b AS (SELECT tr.* FROM tr JOIN l USING (stream, end_t) WHERE begin_t = 0) SELECT stream, arg_min(wid, (-score, wid))::INT AS wid, max(score) AS score FROM b GROUP BY stream")
def isolated_word(spark, d):
    return B.isolated_best(_trellis(spark, d))


@register(f"WITH {TRELLIS} SELECT stream, id, round(score - CASE WHEN id % 3 = 0 THEN 0 ELSE k * 10.0 END, 4) + 0.0 AS backscore FROM tr")
def discounted_scores(spark, d):
    t = _trellis(spark, d)
    at = t.where("id % 3 != 0").select("stream", "id", (F.col("k") * 10.0).alias("am"))
    return B.discounted(t.withColumn("lm", F.lit(0.0)), at).select("stream", "id", rounded("backscore", 4).alias("backscore"))


@register(f"WITH {FRAMES} SELECT process, process || '/' || stream AS stream, t FROM fr, (VALUES ('large'), ('small')) p(process)")
def processes(spark, d):
    return B.for_processes(frames(spark, d), ["small", "large"]).select("process", "stream", "t")


@register(f"WITH {NBEST}, e AS (SELECT stream, rank, dayofweek(day) AS gram, score FROM nr), x AS (SELECT *, pow(10, 0.05 * (score - max(score) OVER (PARTITION BY stream, gram))) AS e FROM e) SELECT stream, gram::INT AS gram, rank::INT AS rank, round(e / sum(e) OVER (PARTITION BY stream, gram), 6) + 0.0 AS confidence FROM x")
def search_confidence(spark, d):
    n = _nbest(spark, d).withColumn("gram", F.dayofweek("day") - 1)
    return n.select("stream", "gram", "rank", rounded(R.softmax10(F.col("score"), ["stream", "gram"])).alias("confidence"))


@register(f"WITH {_DICT}, p AS (SELECT w, lag(w) OVER (PARTITION BY w[1:1] ORDER BY w) AS v FROM dw) SELECT w, v, levenshtein(w, v)::INT AS distance FROM p WHERE v IS NOT NULL")
def phone_distance(spark, d):
    k = Window.partitionBy(F.substring("w", 1, 1)).orderBy("w")
    p = _dictionary(spark, d).select("w", "phones", F.lag("w").over(k).alias("v"), F.lag("phones").over(k).alias("q")).where("v is not null")
    return p.select("w", "v", R.word_distance(F.col("phones"), F.col("q")).alias("distance"))


# --- lattices -----------------------------------------------------------------------------------------------------
@register(f"WITH {LATTICE}, m AS (SELECT stream, id, wid, left_t, right_t, fscore, id % 2 AS head FROM ln UNION ALL SELECT stream, id + 1000000, wid, left_t, right_t, fscore, id % 2 FROM ln WHERE id % 3 = 0) SELECT stream, min(id) AS id, wid::INT AS wid, left_t, right_t, head FROM m GROUP BY stream, wid, head, left_t, right_t, fscore")
def lattice_merge_same(spark, d):
    n, e = _lattice(spark, d)
    n = n.withColumn("head", F.col("id") % 2).withColumn("tail", F.lit(0)).withColumn("bscore", F.lit(0.0))
    again = n.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000)
    return W.merge_same(n.unionByName(again), e)[0].select("stream", "id", "wid", "left_t", "right_t", "head")


@register(f"WITH {LATTICE}, w AS (SELECT * REPLACE (right_t + id % 3 AS right_t) FROM ln), n AS (SELECT le.stream, src AS id, min(b.left_t) AS n FROM le JOIN ln b ON b.stream = le.stream AND b.id = dst GROUP BY ALL) SELECT stream, id, left_t, greatest(left_t, coalesce(n - 1, right_t)) AS right_t FROM w LEFT JOIN n USING (stream, id)")
def lattice_boundaries(spark, d):
    n, e = _lattice(spark, d)
    return W.adjust_boundaries(n.withColumn("right_t", F.col("right_t") + F.col("id") % 3), e).select("stream", "id", "left_t", "right_t")


@register(f"WITH {LATTICE} SELECT stream, id, printf('%d: [%d..%d] wid=%d amavg=%.6f cm=%.6f', id, left_t, right_t, wid, -0.5::DOUBLE, 0.25::DOUBLE) AS line FROM ln")
def lattice_lines(spark, d):
    n, _ = _lattice(spark, d)
    return sinks.graph_lines(n.withColumn("amavg", F.lit(-0.5)).withColumn("cm", F.lit(0.25)))


# --- acoustic scores ----------------------------------------------------------------------------------------------
ORACLES_OF_MIXTURE = ORACLES["mixture_score"]


@register(ORACLES_OF_MIXTURE)
def score_dispatch(spark, d):
    """The same scores through the one entrance that chooses how states are scored."""
    from cadenza.plans.model_queries import mixture_score

    return mixture_score(spark, d)


@register(f"SELECT stream, t, state, coalesce(score, -1000000.0) AS score FROM (SELECT DISTINCT label AS stream, vec_id % 7 AS t, 0 AS state FROM embeddings UNION SELECT DISTINCT label, vec_id % 7, 99 FROM embeddings) LEFT JOIN ({ORACLES_OF_MIXTURE}) m USING (stream, t, state)")
def needed_scores(spark, d):
    from cadenza.plans.model_queries import mixture_score

    at = table(spark, d, "embeddings").select(F.col("label").alias("stream"), (F.col("vec_id") % 7).alias("t"), F.explode(F.array(F.lit(0), F.lit(99))).alias("state"))
    return A.needed_scores(at, mixture_score(spark, d)).select("stream", "t", "state", "score")


@register(f"WITH {FRAMES} SELECT stream, t, len(list_filter(vec, lambda x: x > 0.05))::INT AS dims, round(list_sum(list_filter(vec, lambda x: x > 0.05)), 6) + 0.0 AS total FROM fr")
def valid_dimensions(spark, d):
    f = frames(spark, d).withColumn("v", A.valid_dims(F.col("vec"), 0.05))
    total = F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return f.select("stream", "t", F.size("v").alias("dims"), rounded(total).alias("total"))


def _layers():
    rng = np.random.default_rng(1)
    return [(rng.normal(0, 0.3, (o, i)), rng.normal(0, 0.1, o)) for i, o in ((64, 32), (32, 16), (16, 10))]


def _network_sql() -> str:
    """The network of dnn_score in SQL: its weights as lists."""
    number = lambda v: "[" + ", ".join(f"{x!r}" for x in map(float, v)) + "]"
    x, steps = "vec", []
    for k, (w, b) in enumerate(_layers()):
        rows = "[" + ", ".join(number(r) for r in w) + "]"
        z = f"list_transform(range(1, {len(b) + 1}), lambda i: list_dot_product(({rows})[i], {x}) + ({number(b)})[i])"
        if k < 2:
            z = f"list_transform({z}, lambda y: CASE WHEN y <= -8 THEN 0.000334 WHEN y >= 8 THEN 0.999666 ELSE 1 / (1 + exp(-y)) END)"
        steps.append(f"l{k} AS (SELECT stream, t, {z} AS vec FROM {'fr' if not k else f'l{k - 1}'})")
    return f"WITH {FRAMES}, {', '.join(steps)}, z AS (SELECT *, list_max(vec) AS top FROM l2), s AS (SELECT *, ln(list_sum(list_transform(vec, lambda y: exp(y - top)))) AS ls FROM z), u AS (SELECT stream, t, unnest(range(10))::INT AS i, unnest(list_transform(vec, lambda y: 0.4342944819032518 * (y - top - ls) + 1)) AS x FROM s) SELECT stream, t, i, round(x, 5) + 0.0 AS v FROM u"


ORACLES["dnn_score"] = _network_sql()


# --- signal and formats -------------------------------------------------------------------------------------------
@register(f"WITH {FRAMES} SELECT stream, t FROM fr WHERE t % 3 <> 0")
def zero_vectors(spark, d):
    f = frames(spark, d).withColumn("vec", F.when(F.col("t") % 3 == 0, F.transform("vec", lambda x: x * 0.0)).otherwise(F.col("vec")))
    return S.strip_zero_vectors(f).select("stream", "t")


@register("SELECT x, ((x & 255) << 8 | (x >> 8 & 255)) - CASE WHEN x & 128 > 0 THEN 65536 ELSE 0 END AS swapped FROM (SELECT DISTINCT (event_id * 37 % 32768)::INT AS x FROM events)")
def swapped_bytes(spark, d):
    x = table(spark, d, "events").select((F.col("event_id") * 37 % 32768).cast("int").alias("x")).distinct()
    return x.select("x", S.swap_bytes(F.col("x")).cast("int").alias("swapped"))


@register("SELECT * FROM (VALUES ('MFCC', 6), ('MFCC_E_D_A', 6 | 64 | 256 | 512), ('MFCC_E_N_D_Z', 6 | 64 | 128 | 256 | 2048), ('FBANK_0', 7 | 8192), ('USER_K', 9 | 4096)) t(name, code)")
def parameter_kinds(spark, d):
    names = ["MFCC", "MFCC_E_D_A", "MFCC_E_N_D_Z", "FBANK_0", "USER_K"]
    return spark.createDataFrame([(S.kind_name(S.kind_code(n)), S.kind_code(n)) for n in names], "name string, code int")


@register("SELECT * FROM (VALUES ('-b', 'search.beam', '400'), ('-n', 'search.sentences', '5'), ('-s', 'search.stack', '50'), ('later', 'search.beam', '800')) t(layer, field, value)")
def merged_options(spark, d):
    c = Z.from_text("-b 400 -n 5 # a comment\n-s 50", env={})
    later = c.merged(Z.parse_options(["-b", "800"]))
    rows = [("-b", "search.beam", str(c.search.beam)), ("-n", "search.sentences", str(c.search.sentences)), ("-s", "search.stack", str(c.search.stack)), ("later", "search.beam", str(later.search.beam))]
    return spark.createDataFrame(rows, "layer string, field string, value string")


@register(f"WITH {STREAMS} SELECT stream, seq, round(x)::DOUBLE AS x, 8000 AS rate FROM st")
def wav_round_trip(spark, d):
    """Samples of every stream recorded as a file each, and read from these."""
    s = streams(spark, d).select("stream", F.lit(0).alias("segment"), "seq", F.round("x").alias("x"))

    def kernel(batches):
        for pdf in batches:
            for stream, wav in zip(pdf["stream"], pdf["wav"]):
                rate, x = readers.parse_wav(wav)
                yield pd.DataFrame({"stream": stream, "seq": np.arange(len(x)), "x": x.astype(float), "rate": rate})

    return sinks.recordings(s, 8_000).mapInPandas(kernel, "stream long, seq long, x double, rate int")


def _per_stream(spark, d, there_and_back):
    def kernel(pdf):
        pdf = pdf.sort_values("t")
        v = there_and_back(np.stack(pdf["vec"].to_numpy()))
        return pd.DataFrame({"stream": pdf["stream"].iloc[0], "t": np.repeat(np.arange(len(v)), v.shape[1]), "i": np.tile(np.arange(v.shape[1]), len(v)), "x": v.astype(float).ravel()})

    f = frames(spark, d).withColumn("vec", F.slice("vec", 1, 8))
    return f.select("stream", "t", "vec").groupBy("stream").applyInPandas(kernel, "stream int, t long, i int, x double").withColumn("x", rounded("x"))


_FIRST = f"WITH {FRAMES}, c AS (SELECT stream, t, unnest(range(8))::INT AS i, unnest(vec[1:8]) AS x FROM fr) SELECT stream, t, i, round(x, 6) + 0.0 AS x FROM c"


@register(_FIRST)
def parameter_file_round_trip(spark, d):
    return _per_stream(spark, d, lambda v: readers.parse_parameters(sinks.parameter_bytes(v, 100_000, S.kind_code("USER")))[2])


@register(_FIRST)
def vector_stream_round_trip(spark, d):
    return _per_stream(spark, d, lambda v: np.stack([x for _, _, x in readers.parse_vector_stream(sinks.vector_stream_bytes([v[:3], v[3:]], 10))[1]]))


@register(f"WITH {FRAMES}, c AS (SELECT stream, unnest(range(64))::INT AS i, unnest(vec) AS x FROM fr) SELECT stream, i, round(avg(x), 4) + 0.0 AS mean, round(var_pop(x), 4) + 0.0 AS variance FROM c GROUP BY ALL")
def norm_file_round_trip(spark, d):
    def kernel(pdf):
        v = np.stack(pdf["vec"].to_numpy())
        back = readers.read_cmn(sinks.cmn_text(v.mean(axis=0).tolist(), v.var(axis=0).tolist()))
        return pd.DataFrame({"stream": pdf["stream"].iloc[0], "i": range(v.shape[1]), "mean": back["mean"], "variance": back["variance"]})

    f = frames(spark, d).select("stream", "vec").groupBy("stream").applyInPandas(kernel, "stream int, i int, mean double, variance double")
    return f.select("stream", "i", rounded("mean", 4).alias("mean"), rounded("variance", 4).alias("variance"))


@register("SELECT * FROM (VALUES (0, 3, 1), (1, 0, 0), (1, 2, 2), (2, 1, 2)) t(src, label, dst)")
def automaton_arcs(spark, d):
    """Arcs of text lines, label 0 to state 0 included."""
    lines = spark.createDataFrame([("0 3 1 0 0",), ("1 0 0 0 0",), ("1 2 2 0 0 # a comment",), ("2 1 2 1 0",), ("2 -1 -1 1 0",)], "value string")
    return readers.parse_dfa_lines(lines)[0]


@register("SELECT * FROM (VALUES (0, false), (1, false), (2, true)) t(id, accept)")
def automaton_states(spark, d):
    lines = spark.createDataFrame([("0 3 1 0 0",), ("1 2 2 0 0",), ("2 -1 -1 1 0",)], "value string")
    return readers.parse_dfa_lines(lines)[1]


# --- results ------------------------------------------------------------------------------------------------------
_LINES = f"{NBEST}, x AS (SELECT stream, rank, array_to_string(words, ' ') AS w, array_to_string(words, ' | ') AS p, array_to_string(list_transform(words, lambda y: '0.500'), ' ') AS c, round(score, 2) AS score FROM nr)"


def _results(spark, d):
    n = _nbest(spark, d)
    return n.select("stream", "rank", "words", F.col("words").alias("phones"), F.transform("words", lambda w: F.lit(0.5)).alias("cms"), F.round("score", 2).alias("score"))


@register(f"WITH {_LINES}, l AS (SELECT stream, rank, unnest(range(5))::INT AS k, unnest(['sentence' || rank || ': ' || w, 'wseq' || rank || ': ' || w, 'phseq' || rank || ': ' || p, 'cmscore' || rank || ': ' || c, 'score' || rank || ': ' || printf('%.6f', score)]) AS line FROM x) SELECT stream, rank::INT AS rank, k, line FROM l")
def result_lines(spark, d):
    return sinks.nbest_lines(_results(spark, d))


@register(f"WITH {NBEST}, x AS (SELECT stream, rank, '<SHYPO RANK=\"' || rank || '\" SCORE=\"' || printf('%.6f', round(score, 2)) || '\">' || array_to_string(list_transform(words, lambda w: '<WHYPO WORD=\"&lt;' || w || '&gt;\" CM=\"0.500\"/>'), '') || '</SHYPO>' AS s FROM nr) SELECT stream, '<RECOGOUT>' || string_agg(s, '' ORDER BY rank) || '</RECOGOUT>' AS xml FROM x GROUP BY stream")
def result_messages(spark, d):
    """Messages with chosen attributes; names are escaped."""
    n = _results(spark, d).withColumn("words", F.transform("words", lambda w: F.concat(F.lit("<"), w, F.lit(">"))))
    return sinks.recognition_xml(n, ("word", "cm"))


@register("SELECT * FROM (VALUES (1, '<INPUT STATUS=\"LISTEN\"/>'), (2, '<REJECTED REASON=\"too_short\"/>'), (3, '<RECOGFAIL/>')) t(stream, xml)")
def status_messages(spark, d):
    return sinks.status_xml(spark.createDataFrame([(1, "LISTEN"), (2, "too_short"), (3, "failed")], "stream int, status string"))


@register(f"WITH {TRELLIS}, m AS (SELECT stream, k // 3 AS slot, wid, score / 4e6 AS cm FROM tr), p AS (SELECT stream, slot, wid, sum(cm) AS pp FROM m GROUP BY ALL), a AS (SELECT * FROM p UNION ALL SELECT stream, slot, NULL, 1 - sum(pp) FROM p GROUP BY ALL HAVING 1 - sum(pp) > 1e-9), r AS (SELECT *, row_number() OVER (PARTITION BY stream, slot ORDER BY pp DESC, wid NULLS FIRST) AS rank FROM a) SELECT stream, slot, string_agg(printf('(%s:%.3f)', coalesce(wid::VARCHAR, '-'), round(pp, 3)), ' ' ORDER BY rank) AS line FROM r GROUP BY ALL")
def network_lines(spark, d):
    m = _trellis(spark, d).select("stream", F.floor(F.col("k") / 3).alias("slot"), "wid", (F.col("score") / 4e6).alias("cm"))
    return sinks.network_lines(W.slot_posteriors(m).withColumn("pp", F.round("pp", 3)))


# --- streams ------------------------------------------------------------------------------------------------------
@register("SELECT user_id AS stream, date_trunc('hour', ts) - to_hours((hour(ts) % 6)::INT) AS start, count(*) AS n, round(avg(value), 5) + 0.0 AS mean FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows of six hours; on a stream the watermark closes them."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), "ts", "value")
    return live.sliding(e, "ts", "6 hours").select("stream", "start", "n", rounded("mean", 5).alias("mean"))


@register("SELECT * FROM (VALUES (0, 'status', 'running'), (1, 'paused', 'paused'), (2, 'resumed', 'running'), (3, 'process_added', 'p'), (4, 'process_deactivated', 'p'), (5, 'grammars_changed', '1'), (6, 'ended', 'ended')) t(n, event, value)")
def control_commands(spark, d):
    c, out = live.Control(), []
    out.append(("status", c.command("STATUS")))
    for event in ("paused", "resumed", "ended"):
        c.bind(event, lambda event=event: out.append((event, c.state)))
    for event in ("process_added", "process_deactivated", "grammars_changed"):
        c.bind(event, lambda x, event=event: out.append((event, str(x))))
    for command in (("PAUSE",), ("RESUME",), ("ADDPROCESS", "p"), ("DEACTIVATEPROCESS", "p"), ("ADDGRAM", "g", ([], {}, [])), ("DIE",)):
        c.command(*command)
        c.apply()
    return spark.createDataFrame([(i, *x) for i, x in enumerate(out)], "n int, event string, value string")


