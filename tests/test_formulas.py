"""Closed forms and brute force for kernels that SQL does not check."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays as A
from cadenza.functions import signal as S
from cadenza.operators import acoustic, dictionary, grammar, lattice, rescore, search, segment, viterbi
from tests.conftest import rows


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c).first()[0]


def test_log_sums(spark):
    assert math.isclose(one(spark, A.log_add(F.lit(-1.0), F.lit(-2.0))), math.log(math.exp(-1) + math.exp(-2)))
    assert one(spark, A.log_add(F.lit(0.0), F.lit(-20.0))) == 0.0
    assert math.isclose(one(spark, A.log_sum_exp(F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0)))), math.log(sum(map(math.exp, (-1, -2, -3)))))
    assert one(spark, A.top_mean(F.array(F.lit(1.0), F.lit(3.0), F.lit(-1e6)), 1)) == 3.0
    assert one(spark, A.top_mean(F.array(F.lit(-1e6)), 2)) == A.LOG_ZERO


def test_sample_operators(spark):
    zeros = [5.0, *[0.0] * 15, 7.0, *[0.0] * 16, 9.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(zeros)], "stream int, seq long, x double")
    assert [r[2] for r in rows(S.strip_runs(df), "seq")] == [5.0, *[0.0] * 15, 7.0, 9.0]
    assert one(spark, S.swap_bytes(F.lit(0x0102))) == 0x0201
    assert one(spark, S.swap_bytes(F.lit(-2))) == -257
    assert [r[2] for r in rows(S.scale_level(spark.createDataFrame([(1, 0, -1.5), (1, 1, 1.5)], "stream int, seq long, x double"), 1.0))] == [-1.0, 1.0]
    tone = np.sin(2 * np.pi * 200 * np.arange(4800) / 48_000) * 1000
    assert np.abs(S.downsample_48_to_16(tone)[100:-100] - tone[::3][100:-100]).max() < 15


def test_frames_and_mfcc(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "stream int, seq long, x double")
    assert [(r[1], r[2][0], r[2][-1]) for r in rows(S.frames(df, 4, 2), "t")] == [(0, 0, 3), (1, 2, 5), (2, 4, 7), (3, 6, 9)]
    assert S.kind_name(S.kind_code("MFCC_E_D_A_Z")) == "MFCC_E_D_A_Z"
    assert S.filter_bank(8, 64).shape == (8, 33) and (S.filter_bank(8, 64) >= 0).all()
    assert S.vtln(1000, 1.0, 0, 8000, 100, 7000) == 1000


def test_zero_cross_needs_a_loud_sample(spark):
    x = [1, -1, 1, 50, -1, 1, -50, 1, -1]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "stream int, seq long, x double")
    assert [r[3] for r in rows(segment.zero_cross_marks(df, 10).select("stream", "seq", "x", "mark"), "seq")] == [0, 0, 0, 0, 1, 0, 0, 1, 0]


def test_pruning_without_slack_is_exact():
    rng = np.random.default_rng(0)
    mean, inv, g = rng.normal(size=(20, 5)), rng.uniform(0.5, 2, (20, 5)), rng.normal(size=20)
    for _ in range(20):
        x = rng.normal(size=5)
        full = sorted(((-0.5 * (g[k] + ((x - mean[k]) ** 2 * inv[k]).sum()), k) for k in range(20)), key=lambda s: (-s[0], s[1]))[:4]
        got = acoustic.pruned_gaussians(x, mean, inv, g, 4, [3, 7])
        assert [k for k, _ in got] == [k for _, k in full]


def test_dnn_is_a_distribution():
    rng = np.random.default_rng(0)
    out = acoustic.dnn_forward(rng.normal(size=(4, 6)), [(rng.normal(size=(5, 6)), np.zeros(5)), (rng.normal(size=(3, 5)), np.zeros(3))], np.zeros(3))
    assert np.allclose((10**out).sum(axis=1), 1)
    assert acoustic.logistic(np.array([-9.0, 9.0])).tolist() == list(acoustic.LOGISTIC_CLAMP)


def test_alignment_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k = 6, 3
        s, trans = rng.normal(size=(n, k)), np.full((k, k), A.LOG_ZERO)
        for i in range(k):
            for j in range(i, min(k, i + 2)):
                trans[i, j] = rng.normal()
        best = max(s[0, p[0]] + sum(trans[p[t - 1], p[t]] + s[t, p[t]] for t in range(1, n)) for p in itertools.product(range(k), repeat=n) if p[0] == 0 and p[-1] == k - 1 and all(trans[a, b] > A.LOG_ZERO for a, b in zip(p, p[1:])))
        assert math.isclose(viterbi.align(s, trans)[0], best)


def test_decoder_and_search_against_all_segmentations():
    words = {0: [0], 1: [0, 1], 2: [1, 0]}
    lm = lambda a, b: -0.1 * b - (0.2 if a == b else 0.0)
    rng = np.random.default_rng(2)
    for _ in range(10):
        n, s = 5, None
        s = rng.normal(size=(n, 2))

        def word(w, a, b):  # best alignment of a word to frames a..b
            p = words[w]
            best = -np.inf
            for cuts in itertools.combinations(range(a + 1, b + 1), len(p) - 1):
                edges = [a, *cuts, b + 1]
                best = max(best, sum(s[t, p[i]] for i in range(len(p)) for t in range(edges[i], edges[i + 1])) - 0.3 * (b - a))
            return best

        found = {}
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), r) for r in range(n)):
            edges = [0, *cuts, n]
            for ws in itertools.product(words, repeat=len(edges) - 1):
                total = sum(word(w, edges[i], edges[i + 1] - 1) + lm(ws[i - 1] if i else None, w) for i, w in enumerate(ws))
                if total > -np.inf:
                    found[ws] = max(found.get(ws, -np.inf), total)
        best = max(found.items(), key=lambda x: x[1])
        d = viterbi.Decoder(words, lm)
        path = viterbi.best_path(d.decode(s), n)
        assert math.isclose(path[-1]["score"], best[1]) and tuple(e["wid"] for e in path) == best[0]
        # every word on every span, then the exact N best
        entries = [{"id": 0, "wid": w, "begin": a, "end": b, "am": word(w, a, b), "lm": lm} for b in range(n) for a in range(b + 1) for w in words if word(w, a, b) > -np.inf]
        for e in sorted(entries, key=lambda e: e["end"]):
            options = [p["best"] + lm(p["wid"], e["wid"]) for p in entries if p["end"] == e["begin"] - 1 and "best" in p] + ([lm(None, e["wid"])] if e["begin"] == 0 else [])
            if options:
                e["best"] = e["am"] + max(options)
        got = search.sentences([e for e in entries if "best" in e], 3, stack=100_000, overflow=100_000)
        want = sorted(found.items(), key=lambda x: -x[1])[:3]
        assert np.allclose([r["score"] for r in got], [v for _, v in want])  # equal scores may come in either order
        assert all(math.isclose(found[tuple(r["words"])], r["score"]) for r in got)


def test_stack_is_bounded_and_ordered():
    s = search.Stack(3)
    for x in (1.0, 5.0, 3.0, 4.0):
        s.put(x, x)
    assert not s.put(0.5, 0.5)
    assert [s.pop()[1] for _ in range(3)] == [5.0, 4.0, 3.0]
    assert viterbi.beam_width(1000, 10_000) == 1000 and viterbi.beam_width(5000, 100) == 200 and viterbi.beam_width(9, 9, 0) == 0


def test_posteriors_by_all_paths():
    rnd = random.Random(3)
    for _ in range(10):
        nodes = [{"id": i, "wid": i % 3, "left_t": i // 2 * 2, "right_t": i // 2 * 2 + 1, "amavg": rnd.uniform(-1, 1)} for i in range(6)]
        edges = [(a, b, rnd.uniform(-1, 1)) for a in range(6) for b in range(6) if b // 2 == a // 2 + 1]
        post, zf, zb = lattice.forward_backward(nodes, edges, 0.3)
        w = {(a, b): x for a, b, x in edges}
        paths = {p: 10 ** (0.3 * (sum(2 * nodes[i]["amavg"] for i in p) + w[p[0], p[1]] + w[p[1], p[2]])) for p in itertools.product((0, 1), (2, 3), (4, 5))}
        z = sum(paths.values())
        assert math.isclose(zf, zb) and math.isclose(zf, math.log10(z))
        for i in range(6):
            assert math.isclose(post[i], sum(v for p, v in paths.items() if i in p) / z)


def test_confusion_network_slots():
    nodes = [{"id": 0, "wid": 1, "left_t": 0, "right_t": 4, "cm": 0.6}, {"id": 1, "wid": 1, "left_t": 0, "right_t": 5, "cm": 0.3}, {"id": 2, "wid": 2, "left_t": 5, "right_t": 9, "cm": 0.5}, {"id": 3, "wid": 3, "left_t": 6, "right_t": 9, "cm": 0.4}]
    slots = lattice.confusion_network(nodes, [(0, 2), (1, 3), (0, 3), (1, 2)], {1: ["a"], 2: ["b", "c"], 3: ["b", "d"]})
    assert [[w for w, _ in s] for s in slots] == [[1, None], [2, 3, None]]
    assert all(math.isclose(sum(p for _, p in s), 1) for s in slots)
    assert lattice.edit_distance(list("kitten"), list("sitting")) == 3


def test_weighted_distance():
    w = {"a": 2.0, "b": 1.0, "c": 3.0}
    assert rescore.weighted_distance(["a", "b"], ["a", "b"], w) == 0
    assert rescore.weighted_distance(["a", "b"], ["a", "c"], w) == 3.0
    assert rescore.weighted_distance(["a"], ["c", "b"], w) == 4.0
    assert rescore.weighted_distance(["a", "b"], ["a", "c"], w, compat=True) in (0.0, 3.0)


@pytest.mark.parametrize("a,b", [([], []), (["x"], []), (["x", "y"], ["y"]), (["k", "i"], ["s", "i", "t"])])
def test_word_distance(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(rescore.word_distance(F.col("a"), F.col("b"))).first()[0] == lattice.edit_distance(a, b)


def language(arcs, accept, most=4):
    out, todo = set(), [(0, ())]
    while todo:
        s, w = todo.pop()
        if accept.get(s):
            out.add(w)
        if len(w) < most:
            todo += [(d, (*w, c)) for x, c, d in arcs if x == s]
    return out


def test_automata_keep_their_language():
    rnd = random.Random(4)
    for _ in range(30):
        n = 5
        arcs = list({(rnd.randrange(n), rnd.randrange(2), rnd.randrange(n)) for _ in range(9)})
        good = {s for s in range(n) if rnd.random() < 0.4}
        before = language(arcs, {s: s in good for s in range(n)})
        a, f = grammar.determinise(arcs, good)
        assert len({(s, c) for s, c, _ in a}) == len(a)
        m, g = grammar.minimise(a, f)
        assert language(a, f) == before == language(m, g)
        assert len(g) <= len(f)
        r, h = grammar.reversed_automaton(a, f)
        assert language(r, h) == {tuple(reversed(w)) for w in before}


def test_grammar_compiler():
    a, f, names = grammar.compile_grammar("S : NS X NE\nX : N\nX : X N\n")
    seen = {tuple(names[c] for c in reversed(w)) for w in language(a, f, 5)}
    assert seen == {("NS", *["N"] * k, "NE") for k in (1, 2, 3)}
    assert set(grammar.generate(a, f, 3, 1)) <= {tuple(reversed(w)) for w in language(a, f, 100)}
    with pytest.raises(grammar.GrammarError):
        grammar.compile_grammar("S : A S B\n")
    with pytest.raises(grammar.GrammarError):
        grammar.compile_grammar("T : A\n")


def test_reader_quirk_and_grammar_set():
    lines = ["0 0 0 0", "0 1 1 0", "1 0 2 0", "2 -1 -1 1"]
    assert (0, 0, 0) in grammar.parse_dfa(lines)[0] and (0, 0, 0) not in grammar.parse_dfa(lines, False)[0]
    assert grammar.parse_dfa(lines)[1][2] is True
    g = grammar.GrammarSet()
    i = g.add("a", [], {}, [1])
    assert not g.live and g.update() and g.active() == [i]
    g.request("deactivate", i)
    assert not g.update() and g.active() == []


def test_dictionary(spark):
    w = spark.createDataFrame([(0, "a", "A", ["k", "a"]), (1, "a", "B", ["k"]), (2, "b", "B", ["sp"])], "wid int, wname string, woutput string, phones array<string>")
    assert dictionary.lookup(w, "a") == 0 and dictionary.lookup(w, "a[B]") == 1 and dictionary.lookup(w, "#2") == 2 and dictionary.lookup(w, "zz") is None
    assert [r[0] for r in w.select(dictionary.triphones(F.col("phones"))).collect()] == [["k+a", "k-a"], ["k"], ["sp"]]
    n = F.lit("l-c+r")
    assert one(spark, F.struct(dictionary.centre(n), dictionary.left_centre(n), dictionary.right_centre(n), dictionary.with_left(n, F.lit("x")), dictionary.with_right(n, F.lit("y")))) == ("c", "l-c", "c+r", "x-c+r", "l-c+y")
    t = spark.createDataFrame([("m", 0, 1, 0.0), ("m", 1, 1, math.log10(0.5)), ("m", 1, 2, math.log10(0.5)), ("x", 0, 1, -1.0), ("x", 1, 2, 0.0)], "model string, i int, j int, logp double")
    assert rows(dictionary.check_models(t)) == [("x", "sum")]


def test_confusion_network_compares_words_once(monkeypatch):
    calls, real = [], lattice.edit_distance
    monkeypatch.setattr(lattice, "edit_distance", lambda a, b: calls.append(1) or real(a, b))
    rng = random.Random(5)
    nodes = [{"id": i, "wid": rng.randrange(3), "left_t": (t := i // 4 * 4), "right_t": t + 3, "cm": 0.25} for i in range(24)]
    edges = [(a["id"], b["id"]) for a in nodes for b in nodes if a["right_t"] + 1 == b["left_t"]]
    slots = lattice.confusion_network(nodes, edges, {0: ["f", "i"], 1: ["o", "p"], 2: ["p"]})
    assert len(slots) == 6 and all(math.isclose(sum(p for _, p in s), 1) for s in slots)
    assert len(calls) <= 9  # pairs of words, not of clusters in every round


def test_dc_removal_halves(spark):
    # the last sample less the mean is 5.5 exactly; the mean's last bit makes it less
    xs = [2.78, 183.74, 12.43, 193.53, 71.31, 186.87, 151.02, 56.21, 166.75, 119.96]
    df = spark.createDataFrame(list(enumerate(xs)), "seq int, x double").withColumn("stream", F.lit(1))
    assert [r.x for r in S.remove_dc(df, 10, 10).where("seq = 9").collect()] == [6.0]


def test_warp_search_does_not_depend_on_files(spark, tmp_path):
    from cadenza.plans.signal_queries import warp_search

    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.repartition(8, (F.xxhash64("event_id") % 8)).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(warp_search(spark, str(tmp_path))) == rows(warp_search(spark, "/root/testdata/sf0.1"))
