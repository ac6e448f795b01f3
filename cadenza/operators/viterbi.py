"""Frame-synchronous Viterbi: forced alignment, beam search over a tree lexicon, and what reads their results.

A kernel runs per stream in applyInPandas: one stream is one task, streams run in parallel. Models are small and go to
the kernel as plain Python objects.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.arrays import LOG_ZERO

#: Widths by kind of model and set-up, the margin and run of early determination.
WIDTH_FACTOR, LEAST_WIDTH, DETERMINE_MARGIN, DETERMINE_FRAMES = 15, 200, 10.0, 6


# --- forced alignment ---------------------------------------------------------------------------------------------
def align(scores: np.ndarray, trans: np.ndarray) -> tuple[float, list[int]]:
    """Best path through states 0..S-1 for scores[t, state]: starts in the first state, ends in the last. trans[i, j] is
    log10; LOG_ZERO forbids. Ties go to the smaller state."""
    n, k = scores.shape
    best = np.full((n, k), LOG_ZERO)
    back = np.full((n, k), -1)
    best[0, 0] = scores[0, 0]
    for t in range(1, n):
        step = np.where((best[t - 1][:, None] <= LOG_ZERO) | (trans <= LOG_ZERO), LOG_ZERO, best[t - 1][:, None] + trans)
        back[t] = step.argmax(axis=0)
        top = step.max(axis=0)
        best[t] = np.where(top <= LOG_ZERO, LOG_ZERO, top + scores[t])
    if best[-1, -1] <= LOG_ZERO:
        return LOG_ZERO, []
    path = [k - 1]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return float(best[-1, -1]), path[::-1]


def forced_alignment(scores: DataFrame, trans: np.ndarray, units: list[str] | None = None, backwards: bool = False) -> DataFrame:
    """(stream, unit, begin_t, end_t, score, frames, mean_score) of the runs of a path through the states of `scores`
    (stream, t, vec of state scores). units names each state (equal neighbours are one unit: state, phone or word
    level); backwards takes the sequence from its end."""
    units = units or [str(i) for i in range(len(trans))]
    if backwards:
        trans, units = trans[::-1, ::-1].T.copy(), units[::-1]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s = np.stack(pdf["vec"].to_numpy()).astype(float)
        t = pdf["t"].to_numpy()
        if backwards:
            s = s[:, ::-1]
        _, path = align(s, trans)
        rows, start = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or units[path[i]] != units[path[start]]:
                total = float(sum(s[k, path[k]] for k in range(start, i)))
                rows.append((pdf["stream"].iloc[0], units[path[start]], int(t[start]), int(t[i - 1]), total, i - start, total / (i - start)))
                start = i
        return pd.DataFrame(rows, columns=["stream", "unit", "begin_t", "end_t", "score", "frames", "mean_score"])

    kind = scores.schema["stream"].dataType.simpleString()
    return scores.select("stream", "t", "vec").groupBy("stream").applyInPandas(kernel, f"stream {kind}, unit string, begin_t long, end_t long, score double, frames long, mean_score double")


# --- tree lexicon -------------------------------------------------------------------------------------------------
def tree_lexicon(words: DataFrame) -> DataFrame:
    """(node, parent, depth, phone, word_ends, words): the distinct phone prefixes of words(wid, phones)."""
    p = words.select("wid", "phones", F.explode(F.sequence(F.lit(1), F.size("phones"))).alias("depth"))
    node = F.array_join(F.slice("phones", 1, F.col("depth")), " ")
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice("phones", F.lit(1), F.col("depth") - 1), " "))
    rows = p.select("wid", "depth", node.alias("node"), parent.alias("parent"), F.element_at("phones", F.col("depth")).alias("phone"), (F.col("depth") == F.size("phones")).alias("_end"))
    return rows.groupBy("node", "parent", "depth", "phone").agg(F.count_if("_end").alias("word_ends"), F.count("*").alias("words"))


def frequent_words(uni: DataFrame, n: int) -> DataFrame:
    """The n words of highest probability (ties: by name), which get branches of their own."""
    return uni.orderBy(F.desc("logp"), "w1").limit(n).select("w1", "logp")


def beam_width(default: int, words: int, given: int | None = None) -> int:
    """0 means full; without a value the smaller of the default and 15 sqrt(words), 200 at least."""
    if given is not None:
        return given
    return max(LEAST_WIDTH, min(default, int(WIDTH_FACTOR * math.sqrt(words))))


def rank_beam(tokens: DataFrame, width: int) -> DataFrame:
    """The `width` best tokens of each frame, as a window (ties: the smaller node)."""
    rk = F.row_number().over(Window.partitionBy("stream", "t").orderBy(F.desc("score"), "node"))
    return tokens.withColumn("rk", rk).where(F.col("rk") <= width)


def score_beam(tokens: DataFrame, width: float) -> DataFrame:
    """Tokens not below the maximum of the frame before less `width`: the threshold lags one frame."""
    top = tokens.groupBy("stream", "t").agg(F.max("score").alias("_top")).select("stream", (F.col("t") + 1).alias("t"), "_top")
    return tokens.join(top, ["stream", "t"], "left").where(F.col("_top").isNull() | (F.col("score") >= F.col("_top") - width)).drop("_top")


def merge_tokens(tokens: DataFrame, pairs: int | None = None) -> DataFrame:
    """One token per (stream, t, node), the best (ties: the smaller last word); with pairs, one per last word and at
    most that many."""
    if pairs is None:
        keep = F.struct("score", (-F.col("last")).alias("n"))
        return tokens.groupBy("stream", "t", "node").agg(F.max_by("last", keep).alias("last"), F.max("score").alias("score"))
    best = tokens.groupBy("stream", "t", "node", "last").agg(F.max("score").alias("score"))
    rk = F.row_number().over(Window.partitionBy("stream", "t", "node").orderBy(F.desc("score"), "last"))
    return best.withColumn("_k", rk).where(F.col("_k") <= pairs).drop("_k")


class Decoder:
    """Beam Viterbi over words that are left-to-right phone sequences, one state a phone, with self loops.

    words: wid to phone ids; bigram(last, wid) gives log10 scores (last None at the start) or None where the pair is not
    allowed. The intra-word factor is the maximum unigram below a node, swapped for the word's own score at its end.
    """

    def __init__(self, words: dict[int, list[int]], bigram, stay: float = -0.3, move: float = -0.3, width: int = 0, score_width: float = -1.0, weight: float = 1.0, penalty: float = 0.0):
        self.words, self.bigram, self.stay, self.move, self.width, self.score_width = words, bigram, stay, move, width, score_width
        self.lm = lambda last, w: None if (b := bigram(last, w)) is None else b * weight + penalty
        nodes: dict[tuple, int] = {}
        self.phone, self.next, self.ends = [], defaultdict(set), defaultdict(list)
        for wid, phones in sorted(words.items()):
            for i in range(1, len(phones) + 1):
                key = tuple(phones[:i])
                if key not in nodes:
                    nodes[key] = len(nodes)
                    self.phone.append(phones[i - 1])
                if i > 1:
                    self.next[nodes[tuple(phones[: i - 1])]].add(nodes[key])
            self.ends[nodes[tuple(phones)]].append(wid)
        self.starts = sorted({nodes[(p[0],)] for p in words.values()})

    def decode(self, scores: np.ndarray) -> list[dict]:
        """All word ends (trellis): id, wid, begin, end, score with everything before, prev id."""
        trellis: list[dict] = []
        # a token is (score, begin frame, id of the word end before), per node and last word
        now = {(n, None): (float(scores[0, self.phone[n]]), 0, None) for n in self.starts}
        before, ended = None, 0  # ended: where the word ends of the last frame begin in the trellis
        for t in range(len(scores)):
            if t:
                new: dict = {}

                def put(key, value):
                    if key not in new or value[0] > new[key][0]:
                        new[key] = value

                for (n, last), (s, b, p) in now.items():
                    put((n, last), (s + self.stay, b, p))
                    for m in self.next[n]:
                        put((m, last), (s + self.move, b, p))
                for e in trellis[ended:]:
                    for n in self.starts:
                        put((n, e["wid"]), (e["score"], t, e["id"]))
                now = {k: (s + float(scores[t, self.phone[k[0]]]), b, p) for k, (s, b, p) in new.items()}
            if before is not None and self.score_width >= 0:
                now = {k: v for k, v in now.items() if v[0] >= before - self.score_width}
            if self.width and len(now) > self.width:
                now = dict(sorted(now.items(), key=lambda x: (-x[1][0], x[0][0], -1 if x[0][1] is None else x[0][1]))[: self.width])
            if not now:
                break
            before = max(v[0] for v in now.values())
            ends: dict = {}
            for (n, last), (s, b, p) in now.items():
                for w in self.ends[n]:
                    lm = self.lm(last, w)
                    if lm is not None and (w not in ends or s + lm > ends[w][0]):
                        ends[w] = (s + lm, b, p, lm)
            ended = len(trellis)
            for w, (s, b, p, lm) in sorted(ends.items()):
                trellis.append({"id": len(trellis), "wid": w, "begin": b, "end": t, "score": s, "lm": lm, "prev": p})
        return trellis


def best_path(trellis: list[dict], frames: int, last_words: set[int] | None = None) -> list[dict]:
    """Back-trace from the best word end on the latest frame that has one (of last_words, if given)."""
    ok = [e for e in trellis if not last_words or e["wid"] in last_words]
    if not ok:
        return []
    at = max(e["end"] for e in ok)
    e = max((x for x in ok if x["end"] == at), key=lambda x: (x["score"], -x["wid"]))
    path = [e]
    while e["prev"] is not None:
        e = trellis[e["prev"]]
        path.append(e)
    return path[::-1]


def decode_streams(scores: DataFrame, decoder: Decoder) -> DataFrame:
    """The trellis of each stream (stream, t, vec of phone scores): word ends, with best marking the best path."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        trellis = decoder.decode(np.stack(pdf["vec"].to_numpy()).astype(float))
        best = {e["id"] for e in best_path(trellis, len(pdf))}
        rows = [(pdf["stream"].iloc[0], e["id"], e["wid"], e["begin"], e["end"], e["score"], e["lm"], e["prev"], e["id"] in best) for e in trellis]
        return pd.DataFrame(rows, columns=["stream", "id", "wid", "begin_t", "end_t", "score", "lm", "prev", "best"]).astype({"prev": "Int64"})

    kind = scores.schema["stream"].dataType.simpleString()
    return scores.select("stream", "t", "vec").groupBy("stream").applyInPandas(kernel, f"stream {kind}, id long, wid long, begin_t long, end_t long, score double, lm double, prev long, best boolean")


# --- reading a trellis --------------------------------------------------------------------------------------------
def interim_best(trellis: DataFrame) -> DataFrame:
    """Best word end of every frame."""
    key = F.struct("score", (-F.col("wid")).alias("n"))
    return trellis.groupBy("stream", F.col("end_t").alias("t")).agg(F.max_by("wid", key).alias("wid"), F.max("score").alias("score"))


def isolated_best(trellis: DataFrame) -> DataFrame:
    """The one word that best explains the whole of a stream: among word ends on its last frame."""
    last = trellis.groupBy("stream").agg(F.max("end_t").alias("end_t"))
    key = F.struct("score", (-F.col("wid")).alias("n"))
    return trellis.where("begin_t = 0").join(last, ["stream", "end_t"]).groupBy("stream").agg(F.max_by("wid", key).alias("wid"), F.max("score").alias("score"))


def determined(frames: DataFrame, margin: float = DETERMINE_MARGIN, run: int = DETERMINE_FRAMES) -> DataFrame:
    """First frame at which a stream's best word end (stream, t, wid, score, top: the best node's score) has been the
    same word, within `margin` of the best node, for more than `run` frames in a row."""
    w = Window.partitionBy("stream").orderBy("t")
    hit = (F.lag("wid").over(w) == F.col("wid")) & (F.col("top") - F.col("score") <= margin)
    marked = frames.withColumn("_miss", F.sum(F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1)).over(w))
    counted = marked.withColumn("_run", F.row_number().over(Window.partitionBy("stream", "_miss").orderBy("t")) - 1)
    return counted.where(F.col("_run") > run).groupBy("stream").agg(F.min("t").alias("t"), F.min_by("wid", "t").alias("wid"))


def segment_words(trellis: DataFrame) -> DataFrame:
    """First and last word of each stream: best word end on the first and on the last frame that has any."""
    b = interim_best(trellis)
    return b.groupBy("stream").agg(F.min_by("wid", "t").alias("first_wid"), F.max_by("wid", "t").alias("last_wid"))


def lattice_of(trellis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the first-pass lattice: mean acoustic score (what a word adds without its language score) by
    frame, and edges from a word end to the words that begin at the next frame."""
    prev = trellis.select("stream", F.col("id").alias("prev"), F.col("score").alias("_before"))
    j = trellis.join(prev, ["stream", "prev"], "left")
    amavg = (F.col("score") - F.coalesce("_before", F.lit(0.0)) - F.col("lm")) / (F.col("end_t") - F.col("begin_t") + 1)
    nodes = j.select("stream", "id", "wid", F.col("begin_t").alias("left_t"), F.col("end_t").alias("right_t"), "score", amavg.alias("amavg"))
    a, b = nodes.alias("a"), nodes.alias("b")
    edges = a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.col("a.right_t") + 1 == F.col("b.left_t")))
    return nodes, edges.select("a.stream", F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def discounted(trellis: DataFrame, at_connection: DataFrame | None = None) -> DataFrame:
    """Scores for the second pass: each word end loses the acoustic score at its connection frame (stream, id, am), or
    its language score where none is given."""
    if at_connection is None:
        return trellis.withColumn("backscore", F.col("score") - F.col("lm"))
    j = trellis.join(at_connection.select("stream", "id", F.col("am").alias("_am")), ["stream", "id"], "left")
    return j.withColumn("backscore", F.col("score") - F.coalesce("_am", F.lit(0.0))).drop("_am")


def for_processes(frames: DataFrame, processes: list[str]) -> DataFrame:
    """Every frame for each of several processes; `stream` becomes (process, stream) as text, so that kernels run once
    for each."""
    p = F.explode(F.array(*map(F.lit, processes)))
    return frames.withColumn("process", p).withColumn("stream", F.concat_ws("/", "process", F.col("stream").cast("string")))
