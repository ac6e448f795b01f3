"""Small hand-made cases for operators that no query exercises."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import acoustic, dictionary, grammar, lattice, ngram, ngram_blocks, search, segment, viterbi
from cadenza.streaming.live import Plugins
from cadenza.plans import language_queries, search_queries
from tests.conftest import rows


def test_purge_goes_on_until_nothing_changes(spark):
    chain = spark.createDataFrame([(1, i, i, i) for i in range(54)], "stream long, id long, left_t long, right_t long")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(53)], "stream long, src long, dst long")
    alone = chain.unionByName(spark.createDataFrame([(1, 98, 0, 50), (1, 99, 51, 99)], chain.schema))
    nodes, left = lattice.purge_dead_ends(alone, edges.unionByName(spark.createDataFrame([(1, 98, 99)], edges.schema)))
    assert rows(nodes.select("id")) == [(98,), (99,)] and rows(left.select("src", "dst")) == [(98, 99)]


def test_direct_scores_refuse_too_many_states(spark, monkeypatch):
    monkeypatch.setattr(acoustic, "MODEL_ROWS", 2)
    with pytest.raises(ValueError):
        acoustic.direct_scores(frames_at(spark, (1, 0)), spark.range(3).withColumnRenamed("id", "state"))


def test_factoring_takes_long_words(spark, tmp_path):
    long = "abcdefghij" * 5
    spark.createDataFrame([(1, f"ab {long}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.node: r.words for r in language_queries.factoring_max(spark, str(tmp_path)).collect()}
    assert got == {" ".join(long[:n]): 2 if n < 3 else 1 for n in range(1, 51)}


def frames_at(spark, *at):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(s, t, [float(x) for x in rng.normal(size=6)]) for s, t in at], "stream long, t long, vec array<double>")


def test_decoding_takes_frames_beyond_the_first_100000(spark, monkeypatch):
    f = frames_at(spark, *[(1, t) for t in range(99_985, 100_015)])
    monkeypatch.setattr(search_queries, "frames", lambda *_: f)
    assert search_queries.beam_decode(spark, "").agg(F.max("end_t")).first()[0] == 29


def test_nbest_search_keeps_utterances_of_streams_apart(spark, monkeypatch):
    f = frames_at(spark, *[(0, t) for t in range(1_200_000, 1_200_012)], *[(1, t) for t in range(12)], *[(None, t) for t in range(12)])
    monkeypatch.setattr(search_queries, "frames", lambda *_: f)
    got = search_queries.nbest_search(spark, "").where("rank = 1").collect()
    assert sorted((str(r.stream), r.u) for r in got) == [("0", 100_000), ("1", 0), ("None", 0)]


def test_model_decision_takes_substrings_of_the_reject_string(spark):
    t = spark.createDataFrame([(1, "noise", -1.0), (1, "voice", -2.0), (2, "noise", -5.0), (2, "voice", -5.0), (3, "oi", 0.0)], "stream int, model string, score double")
    got = {r.stream: (r.model, r.accepted) for r in segment.decide_model(t, "noise,laugh").collect()}
    assert got == {1: ("noise", False), 2: ("noise", False), 3: ("oi", False)}


def test_hysteresis_has_no_decision_before_the_ring_is_full(spark):
    df = spark.createDataFrame([(1, t, 1.0) for t in range(4)], "stream int, t long, score double")
    assert [r[1] for r in rows(segment.hysteresis(df, ring=3).select("t", "state"), "t")] == [0, 0, 1, 1]


def test_language_model_helpers(spark):
    uni = spark.createDataFrame([("<s>", -99.0, -0.1), ("</s>", -1.0, None), ("<UNK>", -2.0, None)], "w1 string, logp double, bow double")
    assert {r.w1: r.logp for r in ngram.repair_unigrams(uni).collect()}["<s>"] == -1.0
    assert ngram.unknown_name(uni) == "<UNK>" and ngram.unknown_name(uni.limit(0)) is None
    scored = spark.createDataFrame([("a", -1.0), ("b", -1.0)], "w string, logp double")
    assert rows(ngram.class_scores(scored, spark.createDataFrame([("a", -0.5)], "w string, cprob double"))) == [("a", -1.5), ("b", -1.0)]
    c = spark.createDataFrame([("<s>", 1, "a", 2), ("x", 5, "</s>", 9), ("x", 5, "x", 5), ("x", 5, "x", 6)], "last string, last_end int, w string, end_t int")
    assert ngram.limit_next(c).count() == 1
    h = spark.createDataFrame([(1, "<s>"), (2, "mid")], "stream int, last string")
    assert [r.accepted for r in ngram.acceptable(h).orderBy("stream").collect()] == [True, False]
    assert [r.accepted for r in ngram.acceptable(h, expected={2: "mid"}).orderBy("stream").collect()] == [True, True]
    w = spark.createDataFrame([("ab", ["a", "b"]), ("ac", ["a", "c"])], "w string, phones array<string>")
    bi = spark.createDataFrame([("x", "ab", -1.0), ("x", "ac", -2.0)], "w1 string, w2 string, logp double")
    assert rows(ngram.context_factoring(w, bi)) == [("x", "a", -1.0), ("x", "a b", -1.0), ("x", "a c", -2.0)]
    nodes = spark.createDataFrame([("p", 1, 0), ("p", 2, 0)], "last string, node int, last_cat int")
    assert rows(ngram.can_follow(nodes, spark.createDataFrame([(1, 5), (2, 6)], "node int, cat int"), spark.createDataFrame([(0, 5)], "c1 int, c2 int"))) == [("p", 1)]
    assert ngram.with_user_scores(spark.createDataFrame([("a", "b")], "w1 string, w2 string"), lambda a, b: F.length(F.concat(a, b)).cast("double")).first().logp == 2.0


def test_dictionary_helpers(spark):
    names = spark.createDataFrame([("a-b+c",), ("x-y+z",)], "name string")
    models = spark.createDataFrame([("a-b+c", "m1")], "name string, model string")
    got = {r.name: (r.model, r.pseudo) for r in dictionary.find_models(names, models, spark.createDataFrame([("y",)], "name string")).collect()}
    assert got == {"a-b+c": ("m1", None), "x-y+z": (None, "y")}
    assert dictionary.depends_on_context(names) and not dictionary.depends_on_context(names.select(F.lit("a").alias("name")))
    w = spark.createDataFrame([(0, "a", ["x", "y"])], "wid int, wname string, phones array<string>")
    assert [r.wid for r in dictionary.append(w, w, 1).orderBy("wid").collect()] == [0, 1]
    s = spark.createDataFrame([(7, 0, 0), (7, 1, 0)], "key int, pos int, wid int")
    assert rows(dictionary.sentence_models(s, w, "key")) == [(7, ["x", "y", "x", "y"])]


def test_grammar_helpers(spark):
    arcs = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "src int, label int, dst int")
    flags = spark.createDataFrame([(0, False), (1, False), (2, True)], "id int, accept boolean")
    terms = spark.createDataFrame([(0, 0), (1, 1)], "cat int, wid int")
    assert rows(grammar.begin_categories(arcs, flags)) == [(1,)] and rows(grammar.end_categories(arcs)) == [(0,)]
    words = spark.createDataFrame([(0, ["sp"]), (1, ["a", "sp"])], "wid int, phones array<string>")
    assert rows(grammar.pause_categories(terms, words)) == [(0,)]
    _, _, t, offsets = grammar.merge([("g", arcs, flags, terms), ("h", arcs, flags, terms)])
    assert offsets == [("g", 0, 0, 0), ("h", 2, 2, 2)] and rows(t) == [("g", 0, 0), ("g", 1, 1), ("h", 2, 2), ("h", 3, 3)]
    assert rows(grammar.owner(t.select("cat"), [("g", 0, 2), ("h", 2, 4)], "cat")) == [(0, "g"), (1, "g"), (2, "h"), (3, "h")]
    s = spark.createDataFrame([(1, 0, [0]), (2, 0, [0]), (2, 1, [1, 5]), (3, 0, [9])], "k int, pos int, cats array<int>")
    r = grammar.accept(s, arcs, flags, "k")
    assert {x.k: x.accepted for x in r.collect()} == {1: False, 2: True, 3: False}
    assert {x.k: x.accepted for x in grammar.accept(s, arcs, flags, "k", compat=True).collect()} == {1: True, 2: True, 3: False}
    assert rows(grammar.following_categories(r.where("k = 1"), arcs, "k")) == [(1, 1)]
    st = spark.createDataFrame([(0, 2), (1, 1)], "hyp int, state int")
    assert [x.accept for x in grammar.acceptable(st, flags).orderBy("hyp").collect()] == [True, False]
    assert grammar.reverse_grammar("S : A B") == "S : B A"


def test_trellis_helpers(spark):
    t = spark.createDataFrame([(1, 0, 5, 0, 2, -3.0, -1.0, None), (1, 1, 6, 3, 4, -5.0, -0.5, 0), (1, 2, 7, 0, 4, -6.0, -1.0, None)], "stream int, id int, wid int, begin_t int, end_t int, score double, lm double, prev int")
    assert rows(viterbi.isolated_best(t)) == [(1, 7, -6.0)]
    nodes, edges = viterbi.lattice_of(t)
    assert rows(edges) == [(1, 0, 1)]
    assert {r.id: round(r.amavg, 6) for r in nodes.collect()} == {0: -0.666667, 1: -0.75, 2: -1.0}
    assert [r.backscore for r in viterbi.discounted(t).orderBy("id").collect()] == [-2.0, -4.5, -5.0]
    am = spark.createDataFrame([(1, 0, -0.5)], "stream int, id int, am double")
    assert [r.backscore for r in viterbi.discounted(t, am).orderBy("id").collect()] == [-2.5, -5.0, -6.0]
    assert [r.stream for r in viterbi.for_processes(am.limit(1), ["p", "q"]).orderBy("stream").collect()] == ["p/1", "q/1"]
    assert viterbi.frequent_words(spark.createDataFrame([("a", -1.0), ("b", -1.0), ("c", -0.5)], "w1 string, logp double"), 2).collect()[1].w1 == "a"
    assert viterbi.merge_tokens(spark.createDataFrame([(1, 0, 2, 7, 1.0), (1, 0, 2, 8, 3.0), (1, 0, 2, 9, 2.0)], "stream int, t int, node int, last int, score double"), 2).count() == 2


def test_alignment_backwards_is_the_mirror(spark):
    trans = np.array([[-0.3, -0.3, -1e6], [-1e6, -0.3, -0.3], [-1e6, -1e6, -0.3]])
    df = spark.createDataFrame([(1, t, [float(-abs(t - 2 * s)) for s in range(3)]) for t in range(6)], "stream int, t long, vec array<double>")
    got = [(r.unit, r.begin_t, r.end_t) for r in viterbi.forced_alignment(df, trans, ["a", "b", "b"]).orderBy("begin_t").collect()]
    assert got[0][0] == "a" and got[-1][2] == 5 and [g[0] for g in got] == ["a", "b"]
    back = viterbi.forced_alignment(df, trans, ["a", "b", "c"], backwards=True).count()
    assert back == 3


def test_lattice_helpers(spark):
    nodes = spark.createDataFrame([(1, 0, 5, 0, 4, 3.0), (1, 1, 5, 1, 5, 2.0), (1, 2, 6, 6, 9, 1.0)], "stream int, id int, wid int, left_t int, right_t int, fscore double")
    edges = spark.createDataFrame([(1, 0, 2, -1.0), (1, 1, 2, -0.5)], "stream int, src int, dst int, lscore double")
    n, e = lattice.merge_near(nodes, edges, 1)
    assert rows(n.select("id")) == [(0,), (2,)] and rows(e) == [(1, 0, 2, -0.5)]
    assert {r.id: r.right_t for r in lattice.adjust_boundaries(nodes, edges).collect()} == {0: 5, 1: 5, 2: 9}
    same = nodes.withColumns({"head": F.lit("a"), "tail": F.lit("b"), "bscore": F.lit(0.0)})
    assert lattice.merge_same(same.unionByName(same.withColumn("id", F.col("id") + 10)), edges)[0].count() == 3


def test_merged_node_shares_an_id(spark):
    nodes = spark.createDataFrame([(1, 7, 5, 0, 4, 3.0), (1, 8, 5, 0, 4, 2.0), (1, 9, 5, 6, 9, 1.0), (1, 7, 5, 6, 9, 0.5), (None, 3, 5, 0, 4, 1.0)], "stream int, id int, wid int, left_t int, right_t int, fscore double")
    n, e = lattice.merge_exact_times(nodes, spark.createDataFrame([(1, 8, 9, -1.0)], "stream int, src int, dst int, lscore double"))
    assert n.columns == nodes.columns
    assert sorted(tuple(r) for r in n.where("stream = 1").collect()) == [(1, 7, 5, 0, 4, 3.0), (1, 9, 5, 6, 9, 1.0)]
    assert n.where("stream is null").count() == 1
    assert rows(e) == [(1, 7, 9, -1.0)]


def test_scores_on_demand(spark):
    s = spark.createDataFrame([(1, 0, 0, -1.0)], "stream int, t int, state int, score double")
    need = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 0, 1)], "stream int, t int, state int")
    assert rows(acoustic.needed_scores(need, s)) == [(1, 0, 0, -1.0), (1, 0, 1, -1e6)]
    f = spark.createDataFrame([(1, 0, [1.0, 2.0])], "stream int, t int, vec array<double>")
    states = spark.createDataFrame([(1,), (4,)], "state int")
    assert rows(acoustic.score(f, {"how": "direct", "states": states})) == [(1, 0, 1, 2.0), (1, 0, 4, -1e6)]
    g = spark.createDataFrame([(0, [0.0], [1.0], 0.0), (1, [0.0, 0.0], [1.0, 1.0], 0.0)], "id int, mean array<double>, invvar array<double>, gconst double")
    assert rows(acoustic.gaussian_scores(f, g)) == [(1, 0, 1, -2.5)]
    mix = spark.createDataFrame([(0, 1, 1, 1, 0.0)], "state int, substream int, k int, id int, logw double")
    assert round(acoustic.score(f, {"gauss": g, "mix": mix}).first().score, 6) == round(-2.5 * 0.4342944819, 6)


def test_results_and_plugins(spark):
    second = spark.createDataFrame([(1, 1, ["a"], -1.0)], "stream int, rank int, words array<string>, score double")
    first = spark.createDataFrame([(1, ["b"], -2.0), (2, ["c"], -3.0), (3, None, None)], "stream int, words array<string>, score double")
    assert [r.status for r in search.with_fallback(second, first).orderBy("stream").collect()] == ["second", "first", "failed"]
    assert [r.status for r in search.with_fallback(second, first, False).orderBy("stream").collect()] == ["second", "failed", "failed"]
    p = Plugins()
    p.register("feature_post", lambda df: df.withColumn("more", F.lit(1)))
    assert "more" in p.through("feature_post", first).columns
    segs = spark.createDataFrame([(1, 1, 10, 12)], "stream int, segment int, first_t int, last_t int")
    fr = spark.createDataFrame([(1, t) for t in range(20)], "stream int, t int")
    assert [(r.t, r.rewound) for r in segment.rewind(fr, segs, 2).orderBy("t").collect()] == [(8, True), (9, True), (10, False), (11, False), (12, False)]


def _disk(spark) -> dict[str, int]:
    """Bytes of the files that shuffles and written tables hold now, by path."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [found.apply(i).getPath() for i in range(found.size())]
    files += glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/*/*.parquet")
    return {f: os.path.getsize(f) for f in files if os.path.exists(f)}


def test_corpus_perplexity_disk(spark):
    """On this table the query took 17 times its input in shuffles and tables as long as n-grams were rows, now 5."""
    d = "/root/testdata/sf0.01"
    before = _disk(spark)
    assert language_queries.doc_perplexity(spark, d).count() == 536
    took = sum(n for f, n in _disk(spark).items() if f not in before)
    assert 0 < took < 8 * sum(os.path.getsize(f"{d}/{t}.parquet") for t in ("documents", "conversations"))


def test_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(ngram_blocks, "TEXT_BYTES", 1)
    b = pa.record_batch({"text": ["a b", None, "", "c"]})
    assert [x["text"].to_pylist() for x in ngram_blocks._pieces(iter([b, b.slice(1)]))] == [["a b"], ["", "c"], ["", "c"]]


@pytest.mark.parametrize(("block", "piece"), [(10**6, 10**6), (50, 10)])
def test_corpus_perplexity_is_that_of_the_tables(spark, block, piece):
    """Odd texts, each word in one block or frequent ones in many: as the joins of words give it."""
    rng = random.Random(5)
    word = lambda n: "abcdefghijklmnopqrstuvwxyz"[min(int(rng.expovariate(0.3)), n)] * rng.randint(1, 2)
    odd = ["", None, "12 !?", "Ünï cödé straße", "İstanbul K", "a", "A-b_c", "z" * 300, "  a\n b ", "<s> a </s>"]
    docs = [*odd, *(" ".join(word(20) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    turns = [*odd, "qqq qqq", *(" ".join(word(25) for _ in range(rng.randint(1, 20))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(3)
    turns = spark.createDataFrame([(i - 5, t) for i, t in enumerate(turns)], "sid long, t string").repartition(2)
    got = {r.sid: r for r in ngram_blocks.corpus_perplexity(docs, "text", turns, "sid", "t", block, piece).collect()}
    tables = ngram.estimate(docs, "id", 3, text="text")
    want = {r.sid: r for r in ngram.perplexity(ngram.sentence_words(turns, "sid", "t"), "sid", tables, 3).collect()}
    assert got.keys() == want.keys() and len(got) == len(odd) + 40  # a null text has no words
    for k, r in want.items():
        assert (got[k].words, got[k].oov) == (r.words, r.oov)
        assert got[k].logp == pytest.approx(r.logp, rel=1e-9) and got[k].perplexity == pytest.approx(r.perplexity, rel=1e-9)


def test_corpus_perplexity_without_a_corpus(spark):
    none = spark.createDataFrame([], "text string")
    turns = spark.createDataFrame([(None, "a b"), (7, "a")], "sid long, t string")
    got = ngram_blocks.corpus_perplexity(none, "text", turns, "sid", "t")
    assert rows(got) == [(None, 3, 3, None, None), (7, 2, 2, None, None)]
    assert ngram_blocks.corpus_perplexity(turns, "t", turns.limit(0), "sid", "t").count() == 0
