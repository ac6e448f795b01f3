"""Queries of decoding, lattice, rescoring and ranking operators.

Days of a user's events play sentence hypotheses, orders of a customer play words of a trellis or lattice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import grammar as G
from cadenza.operators import lattice as W
from cadenza.operators import ngram as L
from cadenza.operators import rescore as R
from cadenza.operators import search as X
from cadenza.operators import viterbi as B
from cadenza.plans.registry import CELLS, STREAMS, frames, register, rounded, streams, table

#: Hypotheses in SQL: a user's days by total value; words are event types, letters stand for them in a string.
NBEST = """nb AS (SELECT user_id AS stream, date_trunc('day', ts) AS day, sum(value) AS score, list(event_type ORDER BY ts, event_id) AS words, string_agg(left(event_type, 1), '' ORDER BY ts, event_id) AS s FROM events GROUP BY ALL),
nr AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY round(score, 6) DESC, day) AS rank FROM nb)"""
#: Words of a trellis in SQL: a customer's orders in order of date.
TRELLIS = """oo AS (SELECT o_custkey AS stream, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS wid, o_totalprice AS score FROM orders),
tr AS (SELECT stream, id, k, wid, k * 2 AS begin_t, k * 2 + id % 4 AS end_t, score FROM oo)"""


def _nbest(spark, d):
    day = F.date_trunc("day", "ts").alias("day")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("stream"), day).agg(F.sum("value").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("words"))
    rk = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc(F.round("score", 6)), "day"))
    return e.withColumn("rank", rk)


def _trellis(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("k", (F.row_number().over(w) - 1).cast("long"))
    wid = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("id"), "k", wid.alias("wid"), (F.col("k") * 2).alias("begin_t"), (F.col("k") * 2 + F.col("o_orderkey") % 4).alias("end_t"), F.col("o_totalprice").alias("score"))


def _lattice(spark, d):
    n = _trellis(spark, d).select("stream", "id", "wid", F.col("begin_t").alias("left_t"), F.col("end_t").alias("right_t"), F.col("score").alias("fscore"))
    n = n.withColumn("left_t", F.floor(F.col("left_t") / 4) * 4).withColumn("right_t", F.greatest("left_t", F.floor(F.col("right_t") / 4) * 4 + 3))
    a, b = n.alias("a"), n.alias("b")
    e = a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.col("a.right_t") + 1 == F.col("b.left_t"))).select("a.stream", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.round(F.log10("b.fscore"), 6).alias("lscore"))
    return n, e


LATTICE = TRELLIS + """, ln AS (SELECT stream, id, wid, begin_t // 4 * 4 AS left_t, greatest(begin_t // 4 * 4, end_t // 4 * 4 + 3) AS right_t, score AS fscore FROM tr),
le AS (SELECT a.stream, a.id AS src, b.id AS dst, round(log10(b.fscore), 6) AS lscore FROM ln a JOIN ln b ON a.stream = b.stream AND a.right_t + 1 = b.left_t)"""


# --- confidence and rescoring -------------------------------------------------------------------------------------
@register(f"WITH {NBEST}, e AS (SELECT *, pow(10, 0.05 * (score - max(score) OVER (PARTITION BY stream))) AS e FROM nr) SELECT stream, rank::INT AS rank, round(e / sum(e) OVER (PARTITION BY stream), 6) + 0.0 AS posterior FROM e")
def nbest_confidence(spark, d):
    return R.sentence_posteriors(_nbest(spark, d)).select("stream", "rank", rounded("posterior").alias("posterior"))


@register(f"WITH {NBEST}, e AS (SELECT *, pow(10, 0.05 * (score - max(score) OVER (PARTITION BY stream))) AS e FROM nr), p AS (SELECT stream, e / sum(e) OVER (PARTITION BY stream) AS p, words FROM e), u AS (SELECT stream, p, unnest(words) AS word FROM p) SELECT stream, word, round(sum(p), 6) + 0.0 AS confidence FROM u GROUP BY ALL HAVING sum(p) >= 0.01")
def word_confidence(spark, d):
    return R.prune(R.word_confidence(_nbest(spark, d)), 0.01).withColumn("confidence", rounded("confidence"))


@register(f"WITH {NBEST}, g AS (SELECT *, a AS alpha FROM nr, (VALUES (0.01::DOUBLE), (0.05), (0.2)) x(a)), e AS (SELECT *, pow(10, alpha * (score - max(score) OVER (PARTITION BY stream))) AS e FROM g), p AS (SELECT stream, alpha, e / sum(e) OVER (PARTITION BY stream, alpha) AS p, words FROM e), u AS (SELECT stream, alpha, p, unnest(words) AS word FROM p) SELECT stream, alpha, word, round(sum(p), 6) + 0.0 AS confidence FROM u GROUP BY ALL")
def confidence_grid(spark, d):
    return R.confidence_grid(_nbest(spark, d), [0.01, 0.05, 0.2]).withColumn("confidence", rounded("confidence"))


@register(f"""WITH {NBEST}, e AS (SELECT *, pow(10, 0.01 * (score - max(score) OVER (PARTITION BY stream))) AS e FROM nr),
r AS (SELECT a.stream, a.rank, sum(b.e * pow(levenshtein(a.s, b.s), 1.5)) AS risk FROM e a JOIN e b USING (stream) GROUP BY ALL)
SELECT stream, rank::INT AS rank, round(risk, 5) + 0.0 AS risk FROM r""")
def mbr_risk(spark, d):
    return R.mbr(_nbest(spark, d), 0.01, 1.5).select("stream", "rank", rounded("risk", 5).alias("risk"))


@register(f"WITH {NBEST} SELECT a.stream, a.rank::INT AS a, b.rank::INT AS b, levenshtein(a.s, b.s)::INT AS distance FROM nr a JOIN nr b ON a.stream = b.stream AND b.rank = a.rank + 1")
def edit_distance(spark, d):
    n = _nbest(spark, d)
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.col("b.rank") == F.col("a.rank") + 1))
    r = j.select("a.stream", F.col("a.rank").alias("first"), F.col("b.rank").alias("second"), R.word_distance(F.col("a.words"), F.col("b.words")).alias("distance"))
    return r.withColumnsRenamed({"first": "a", "second": "b"})


@register(f"WITH {NBEST}, g AS (SELECT stream, score, words, dayofweek(day) AS gram FROM nr), r AS (SELECT *, row_number() OVER (PARTITION BY stream, gram ORDER BY score DESC, words) AS rank FROM g) SELECT stream, gram::INT AS gram, rank::INT AS rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 2")
def per_grammar_nbest(spark, d):
    n = _nbest(spark, d).select("stream", "score", "words", (F.dayofweek("day") - 1).alias("gram"))
    return X.per_grammar(n, 2).select("stream", "gram", "rank", rounded("score").alias("score"))


@register(f"WITH {NBEST}, s AS (SELECT stream, score FROM nr WHERE rank = 1 AND stream % 3 = 0), f AS (SELECT stream, score FROM nr WHERE rank = 2) SELECT f.stream, round(coalesce(s.score, f.score), 6) + 0.0 AS score, CASE WHEN s.stream IS NOT NULL THEN 'second' ELSE 'first' END AS status FROM f LEFT JOIN s USING (stream)")
def fallback_result(spark, d):
    n = _nbest(spark, d)
    return X.with_fallback(n.where("stream % 3 = 0"), n.where("rank = 2")).select("stream", rounded("score").alias("score"), "status")


# --- first and second pass ----------------------------------------------------------------------------------------
def _tokens(spark, d):
    return streams(spark, d).select("stream", F.floor(F.col("seq") / 8).alias("t"), F.length("event_type").alias("node"), (F.col("seq") % 5).alias("last"), F.col("x").alias("score"))


_TOKENS = f"{STREAMS}, tn AS (SELECT stream, seq // 8 AS t, len(event_type) AS node, seq % 5 AS last, x AS score FROM st)"


@register(f"WITH {_TOKENS}, b AS (SELECT stream, t, node, max(score) AS score, max(-last) AS nl FROM (SELECT *, max(score) OVER (PARTITION BY stream, t, node) AS mx FROM tn) WHERE score = mx GROUP BY ALL) SELECT stream, t, node::INT AS node, -nl AS last, score FROM b")
def token_merge(spark, d):
    return B.merge_tokens(_tokens(spark, d)).select("stream", "t", "node", "last", "score")


@register(f"WITH {_TOKENS}, b AS (SELECT stream, t, node, max(score) AS score FROM tn GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream, t ORDER BY score DESC, node) AS rk FROM b) SELECT stream, t, node::INT AS node, score, rk::INT AS rk FROM r WHERE rk <= 2")
def beam_topk(spark, d):
    return B.rank_beam(B.merge_tokens(_tokens(spark, d)), 2).select("stream", "t", "node", "score", "rk")


@register(f"WITH {_TOKENS}, m AS (SELECT stream, t + 1 AS t, max(score) AS top FROM tn GROUP BY ALL) SELECT stream, t, node::INT AS node, score FROM tn LEFT JOIN m USING (stream, t) WHERE top IS NULL OR score >= top - 30")
def score_beam(spark, d):
    return B.score_beam(_tokens(spark, d), 30).select("stream", "t", "node", "score")


@register(f"WITH {TRELLIS} SELECT stream, end_t AS t, arg_min(wid, (-score, wid))::INT AS wid, max(score) AS score FROM tr GROUP BY ALL")
def interim_best(spark, d):
    return B.interim_best(_trellis(spark, d))


@register(f"WITH {TRELLIS}, b AS (SELECT stream, end_t AS t, arg_min(wid, (-score, wid)) AS wid FROM tr GROUP BY ALL) SELECT stream, arg_min(wid, t)::INT AS first_wid, arg_max(wid, t)::INT AS last_wid FROM b GROUP BY stream")
def segment_words(spark, d):
    return B.segment_words(_trellis(spark, d))


@register(f"""WITH {STREAMS}, h AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY stream ORDER BY seq) = event_type AND 70 - x <= 40, false) AS hit FROM st),
m AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS miss FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY stream, miss ORDER BY seq) - 1 AS run FROM m)
SELECT stream, min(seq) AS t, arg_min(event_type, seq) AS wid FROM r WHERE run > 1 GROUP BY stream""")
def early_determination(spark, d):
    s = streams(spark, d).select("stream", F.col("seq").alias("t"), F.col("event_type").alias("wid"), F.col("x").alias("score"), F.lit(70.0).alias("top"))
    return B.determined(s, 40, 1)


@register(f"WITH {TRELLIS} SELECT a.stream, a.id AS src, b.id AS dst FROM tr a JOIN tr b ON a.stream = b.stream AND a.end_t + 1 = b.begin_t")
def lattice_links(spark, d):
    t = _trellis(spark, d).withColumn("prev", F.lit(None).cast("long")).withColumn("lm", F.lit(0.0))
    return B.lattice_of(t)[1]


@register(f"WITH {TRELLIS}, h AS (SELECT DISTINCT stream, 1 AS hyp, k * 3 AS t, k % 7 * 1000.0 AS g FROM tr) SELECT h.stream, hyp, wid::INT AS wid, max(g + score) AS f, arg_min(h.t, (-(g + score), h.t)) AS t FROM h JOIN tr ON tr.stream = h.stream AND tr.end_t = h.t GROUP BY ALL")
def connect_hypotheses(spark, d):
    t = _trellis(spark, d)
    h = t.select("stream", F.lit(1).alias("hyp"), (F.col("k") * 3).alias("t"), (F.col("k") % 7 * 1000.0).alias("g")).distinct()
    return X.connect(h, t.select("stream", F.col("end_t").alias("t"), "wid", F.col("score").alias("backscore"))).select("stream", "hyp", "wid", "f", "t")


@register(f"WITH {TRELLIS}, e AS (SELECT *, max(score) OVER (PARTITION BY stream, wid ORDER BY k ROWS UNBOUNDED PRECEDING) AS env FROM tr) SELECT stream, k AS n, wid::INT AS t, score AS g, env AS envelope FROM e WHERE score >= env - 50000")
def scan_envelope(spark, d):
    p = _trellis(spark, d).select("stream", F.col("k").alias("n"), F.col("wid").alias("t"), F.col("score").alias("g"))
    return X.scan_prune(p, 50000)


@register(f"""WITH {TRELLIS}, h AS (SELECT DISTINCT stream, 0 AS hyp, 9 AS t0 FROM tr), j AS (SELECT h.stream, hyp, t0, wid, end_t, score, row_number() OVER (PARTITION BY h.stream, hyp, wid ORDER BY abs(end_t - t0), end_t, id) AS rk FROM h JOIN tr ON h.stream = tr.stream AND abs(end_t - t0) < 5)
SELECT stream, hyp, wid::INT AS wid, end_t FROM j WHERE rk = 1""")
def trellis_range_join(spark, d):
    t = _trellis(spark, d).select("stream", "wid", "end_t", F.col("score").alias("backscore"))
    h = t.select("stream", F.lit(0).alias("hyp"), F.lit(9).alias("t0")).distinct()
    return L.trellis_words(h, t).select("stream", "hyp", "wid", "end_t")


@register(f"WITH {TRELLIS}, w AS (SELECT DISTINCT stream, 0 AS hyp, wid, 8 AS t0 FROM tr) SELECT w.stream, w.wid::INT AS wid, arg_min(end_t, (abs(end_t - t0), end_t)) AS end_t FROM w JOIN tr ON tr.stream = w.stream AND tr.wid = w.wid AND abs(end_t - t0) <= 6 GROUP BY ALL")
def trellis_look_around(spark, d):
    t = _trellis(spark, d).select("stream", "wid", "end_t")
    w = t.select("stream", F.lit(0).alias("hyp"), "wid", F.lit(8).alias("t0")).distinct()
    return G.look_around(w, t, 6).select("stream", "wid", "end_t")


_STEP = math.log10(0.5)


@register(f"""WITH RECURSIVE {CELLS}, s AS (SELECT stream, t, max(x) FILTER (WHERE i = 0) AS a, max(x) FILTER (WHERE i = 1) AS b, max(x) FILTER (WHERE i = 2) AS c FROM ce GROUP BY ALL), n AS (SELECT stream, max(t) AS last FROM s GROUP BY stream),
r AS (SELECT stream, t, a, -1e300::DOUBLE AS b, -1e300::DOUBLE AS c FROM s WHERE t = 0 UNION ALL SELECT s.stream, s.t, r.a + s.a, greatest(r.a, r.b) + s.b, greatest(r.b, r.c) + s.c FROM r JOIN s ON s.stream = r.stream AND s.t = r.t + 1)
SELECT r.stream, round(r.c, 5) + 0.0 AS score, (last + 1)::BIGINT AS frames FROM r JOIN n ON n.stream = r.stream AND n.last = r.t""")
def viterbi_align(spark, d):
    trans = np.full((3, 3), -1e6)
    for i in range(3):
        trans[i, i] = _STEP
        if i < 2:
            trans[i, i + 1] = _STEP
    f = frames(spark, d).withColumn("vec", F.slice("vec", 1, 3))
    a = B.forced_alignment(f, trans)
    return a.groupBy("stream").agg(rounded(F.sum("score"), 5).alias("score"), F.sum("frames").alias("frames"))


_WORDS = {0: [0, 1], 1: [0, 2, 3], 2: [4], 3: [4, 5, 1], 4: [2, 5]}


def _decoder():
    lm = lambda last, w: -0.2 * w - (0.3 if last == w else 0.1)
    return B.Decoder(_WORDS, lm, width=40)


@register()
def beam_decode(spark, d):
    f = frames(spark, d).withColumn("vec", F.transform(F.slice("vec", 1, 6), lambda x: x * 4))
    t = B.decode_streams(f, _decoder()).where("best")
    return t.select("stream", "id", "wid", "begin_t", "end_t", rounded("score", 5).alias("score"))


@register()
def nbest_search(spark, d):
    f = frames(spark, d)
    kind = f.schema["stream"].dataType.simpleString()
    f = f.withColumn("u", F.floor(F.col("t") / 12)).withColumn("stream", F.to_json(F.struct("stream", "u"))).withColumn("t", F.col("t") % 12).withColumn("vec", F.transform(F.slice("vec", 1, 6), lambda x: x * 4))
    t = B.decode_streams(f, _decoder())
    prev = t.select("stream", F.col("id").alias("prev"), F.col("score").alias("_b"))
    t = t.join(prev, ["stream", "prev"], "left").withColumn("am", F.col("score") - F.coalesce("_b", F.lit(0.0)) - F.col("lm"))
    lm = {(a, b): -0.2 * b - (0.3 if a == b else 0.1) for a in [None, *_WORDS] for b in _WORDS}
    r = X.nbest(t, lm, 3)
    r = r.withColumn("_k", F.from_json("stream", f"stream {kind}, u long"))
    return r.select("_k.stream", "_k.u", "rank", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("words"), rounded("score", 5).alias("score"))


# --- lattices -----------------------------------------------------------------------------------------------------
@register(f"WITH {LATTICE}, m AS (SELECT stream, wid, left_t, right_t, arg_min(id, (-fscore, id)) AS kept, max(fscore) AS fscore, count(*) AS merged FROM ln GROUP BY ALL) SELECT stream, kept AS id, wid::INT AS wid, left_t, right_t, fscore FROM m")
def lattice_merge_exact(spark, d):
    return W.merge_exact_times(*_lattice(spark, d))[0].select("stream", "id", "wid", "left_t", "right_t", "fscore")


@register(f"WITH {LATTICE}, m AS (SELECT stream, id, first_value(id) OVER (PARTITION BY stream, wid, left_t, right_t ORDER BY fscore DESC, id) AS kept FROM ln) SELECT le.stream, a.kept AS src, b.kept AS dst, max(lscore) AS lscore FROM le JOIN m a ON a.stream = le.stream AND a.id = src JOIN m b ON b.stream = le.stream AND b.id = dst WHERE a.kept <> b.kept GROUP BY ALL")
def lattice_merged_edges(spark, d):
    return W.merge_exact_times(*_lattice(spark, d))[1]


@register()
def lattice_merge_near(spark, d):
    return W.merge_near(*_lattice(spark, d), 4)[0].select("stream", "id", "wid", "left_t", "right_t")


@register(f"WITH {LATTICE}, f AS (SELECT stream, id, row_number() OVER (PARTITION BY stream, t ORDER BY fscore DESC, id) AS rk FROM (SELECT *, unnest(range(left_t, right_t + 1)) AS t FROM ln)), b AS (SELECT stream, id FROM f GROUP BY ALL HAVING min(rk) <= 2) SELECT stream, id FROM b")
def lattice_depth_cut(spark, d):
    return W.depth_cut(_lattice(spark, d)[0], 2).select("stream", "id")


@register(f"WITH {LATTICE} SELECT stream, id AS old_id, row_number() OVER (PARTITION BY stream ORDER BY left_t, right_t, wid, id) - 1 AS id FROM ln")
def lattice_numbering(spark, d):
    return W.numbered(_lattice(spark, d)[0]).select("stream", "old_id", F.col("id").cast("long").alias("id"))


@register(f"WITH {LATTICE}, a AS (SELECT stream, src, dst FROM le WHERE src % 5 <> 0), b AS (SELECT stream, src, dst FROM le WHERE dst % 7 <> 0) SELECT stream, src, dst, CASE WHEN src % 5 = 0 THEN 'left' ELSE 'right' END AS missing FROM le WHERE (src % 5 <> 0) <> (dst % 7 <> 0)")
def lattice_coherence(spark, d):
    _, e = _lattice(spark, d)
    return W.incoherent(e.where("src % 5 != 0"), e.where("dst % 7 != 0"))


@register(f"WITH RECURSIVE {LATTICE}, c AS (SELECT DISTINCT stream, src AS a, dst AS b FROM le UNION SELECT c.stream, c.a, le.dst FROM c JOIN le ON le.stream = c.stream AND le.src = c.b) SELECT stream, a, b FROM c")
def order_closure(spark, d):
    return W.precedence(_lattice(spark, d)[1])


@register(f"""WITH RECURSIVE {LATTICE}, nl AS (SELECT *, max(right_t) OVER (PARTITION BY stream) AS last FROM ln),
f AS (SELECT stream, id FROM nl WHERE left_t = 0 UNION SELECT le.stream, le.dst FROM f JOIN le ON le.stream = f.stream AND le.src = f.id),
b AS (SELECT stream, id FROM nl WHERE right_t = last UNION SELECT le.stream, le.src FROM b JOIN le ON le.stream = b.stream AND le.dst = b.id)
SELECT stream, id FROM f JOIN b USING (stream, id)""")
def lattice_purge(spark, d):
    return W.purge_dead_ends(*_lattice(spark, d))[0].select("stream", "id")


def _scored(spark, d):
    n, e = _lattice(spark, d)
    n = n.withColumn("amavg", F.log10("fscore") - 5)
    p = W.posteriors(n, e)
    return n.join(p, ["stream", "id"]), e


@register()
def lattice_posteriors(spark, d):
    return _scored(spark, d)[0].select("stream", "id", rounded("cm").alias("cm"))


@register()
def confusion_network(spark, d):
    n, e = _scored(spark, d)
    r = W.confusion_networks(n, e, {0: ["f", "i"], 1: ["o", "p"], 2: ["p"]})
    return r.select("stream", "slot", "rank", "wid", rounded("pp").alias("pp"))


@register(f"WITH {TRELLIS}, m AS (SELECT stream, k // 3 AS slot, wid, score / 4e6 AS cm FROM tr), p AS (SELECT stream, slot, wid, sum(cm) AS pp FROM m GROUP BY ALL), a AS (SELECT * FROM p UNION ALL SELECT stream, slot, NULL, 1 - sum(pp) FROM p GROUP BY ALL HAVING 1 - sum(pp) > 1e-9) SELECT stream, slot, wid::INT AS wid, round(pp, 6) + 0.0 AS pp, row_number() OVER (PARTITION BY stream, slot ORDER BY pp DESC, wid NULLS FIRST)::INT AS rank FROM a")
def confnet_posterior(spark, d):
    m = _trellis(spark, d).select("stream", F.floor(F.col("k") / 3).alias("slot"), "wid", (F.col("score") / 4e6).alias("cm"))
    return W.slot_posteriors(m).select("stream", "slot", "wid", rounded("pp").alias("pp"), "rank")
