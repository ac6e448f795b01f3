"""Second pass: best-first search with a bounded stack for N sentences, and what orders results."""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stack size, popped hypotheses at most, word-depth envelopes, score envelope of a scan.
STACK, OVERFLOW, ENVELOPE_FAST, ENVELOPE, SCAN_BEAM = 500, 2000, 30, 100, 80.0


class Stack:
    """Hypotheses from best to worst; a full stack loses its worst. A new one goes before equals in the upper half,
    behind them in the lower half."""

    def __init__(self, size: int = STACK):
        self.size, self.items, self.keys = size, [], []

    def put(self, score: float, item) -> bool:
        if len(self.items) >= self.size and score <= -self.keys[-1]:
            return False
        i = bisect.bisect_left(self.keys, -score)
        if i > len(self.keys) // 2:
            i = bisect.bisect_right(self.keys, -score)
        self.keys.insert(i, -score)
        self.items.insert(i, item)
        if len(self.items) > self.size:
            self.keys.pop()
            self.items.pop()
        return True

    def pop(self):
        return -self.keys.pop(0), self.items.pop(0)

    def __len__(self) -> int:
        return len(self.items)


def sentences(trellis: list[dict], n: int = 10, start_words: set[int] | None = None, stack: int = STACK, overflow: int = OVERFLOW, envelope: int | None = None) -> list[dict]:
    """N best sentences over a trellis (id, wid, begin, end, am, lm(prev wid, wid)), built from the last word to the
    first: a hypothesis's estimate is its score plus the best score that any first-pass path has up to its start.

    trellis entries hold `am`, the word's own acoustic score, and `best`, the best score of a path that ends with it.
    """
    if not trellis:
        return []
    by_end: dict[int, list[dict]] = {}
    for e in trellis:
        by_end.setdefault(e["end"], []).append(e)
    lm = trellis[0]["lm"]
    last = max(by_end)
    s, popped, seen, out, results = Stack(stack), 0, Counter(), [], set()
    for e in by_end[last]:
        s.put(e["best"], {"seq": [e], "g": e["am"]})
    while len(s) and len(out) < n and popped < overflow:
        f, h = s.pop()
        popped += 1
        first = h["seq"][0]
        if first["begin"] == 0:
            total = h["g"] + lm(None, first["wid"])
            if not h.get("final"):
                s.put(total, h | {"final": True})
                continue
            words = tuple(e["wid"] for e in h["seq"])
            if words not in results and (not start_words or words[0] in start_words):
                results.add(words)
                out.append({"rank": len(out) + 1, "words": list(words), "score": f, "ends": [e["end"] for e in h["seq"]]})
            continue
        if envelope is not None:
            depth = len(h["seq"])
            if any(c > envelope for d, c in seen.items() if d >= depth):
                continue
            seen[depth] += 1
        for e in by_end.get(first["begin"] - 1, []):
            g = h["g"] + lm(e["wid"], first["wid"]) + e["am"]
            s.put(g - e["am"] + e["best"], {"seq": [e, *h["seq"]], "g": g})
    return out


def nbest(trellis: DataFrame, lm: dict[tuple[int | None, int], float], n: int = 10, default: float = -5.0, **limits) -> DataFrame:
    """(stream, rank, words, score) from a trellis table (stream, id, wid, begin_t, end_t, am). Forward scores are
    computed per stream first, then searched backwards."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        score = lambda a, b: lm.get((a, b), default)
        entries = [{"id": r.id, "wid": r.wid, "begin": r.begin_t, "end": r.end_t, "am": r.am, "lm": score} for r in pdf.sort_values(["end_t", "begin_t", "wid"]).itertuples()]
        ended: dict[int, list[dict]] = {}  # in order of their end, so those before an entry are complete
        for e in entries:
            before = [p["best"] + score(p["wid"], e["wid"]) for p in ended.get(e["begin"] - 1, [])]
            start = [score(None, e["wid"])] if e["begin"] == 0 else []
            if before or start:
                e["best"] = e["am"] + max(before + start)
                ended.setdefault(e["end"], []).append(e)
        rows = [(pdf["stream"].iloc[0], r["rank"], r["words"], r["score"]) for r in sentences([e for e in entries if "best" in e], n, **limits)]
        return pd.DataFrame(rows, columns=["stream", "rank", "words", "score"])

    kind = trellis.schema["stream"].dataType.simpleString()
    return trellis.select("stream", "id", "wid", "begin_t", "end_t", "am").groupBy("stream").applyInPandas(kernel, f"stream {kind}, rank int, words array<long>, score double")


def connect(hypotheses: DataFrame, trellis: DataFrame) -> DataFrame:
    """f = max over t of g[t] + backscore_t, with the best t, for hypotheses (stream, hyp, t, g) and the trellis words
    (stream, t, wid, backscore) that end there."""
    j = hypotheses.join(trellis, ["stream", "t"]).withColumn("f", F.col("g") + F.col("backscore"))
    return j.groupBy("stream", "hyp", "wid").agg(F.max("f").alias("f"), F.max_by("t", F.struct("f", -F.col("t"))).alias("t"))


def envelope_update(popped: DataFrame) -> DataFrame:
    """Best score seen per frame so far, in the order of popping (stream, n, t, g)."""
    return popped.withColumn("envelope", F.max("g").over(Window.partitionBy("stream", "t").orderBy("n")))


def scan_prune(popped: DataFrame, width: float = SCAN_BEAM) -> DataFrame:
    return envelope_update(popped).where(F.col("g") >= F.col("envelope") - width)


def with_fallback(second: DataFrame, first: DataFrame, use_first: bool = True) -> DataFrame:
    """Streams with their best second-pass sentence, else the first pass's, else status failed."""
    best = second.where("rank = 1").select("stream", "words", "score")
    f = first.select("stream", F.col("words").alias("_w"), F.col("score").alias("_s"))
    j = f.join(best, "stream", "left")
    status = F.when(F.col("words").isNotNull(), "second").when(F.lit(use_first) & F.col("_w").isNotNull(), "first").otherwise("failed")
    return j.select("stream", F.coalesce("words", F.when(F.lit(use_first), F.col("_w"))).alias("words"), F.coalesce("score", F.when(F.lit(use_first), F.col("_s"))).alias("score"), status.alias("status"))


def per_grammar(sentences_: DataFrame, n: int) -> DataFrame:
    """The n best of each grammar (stream, gram, score, words)."""
    rk = F.row_number().over(Window.partitionBy("stream", "gram").orderBy(F.desc("score"), "words"))
    return sentences_.withColumn("rank", rk).where(F.col("rank") <= n)
