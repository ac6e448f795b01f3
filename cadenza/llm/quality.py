"""Quality of a text by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes, all of them. Every passage is encoded (hashed counts of its bytes and
byte pairs, then a learned layer); gated attention weighs the passages; the weighted sum gives the score. Only the
document's label is known, so attention learns which passages carry it. Trained in numpy on a bounded sample.

Null and empty texts are one empty passage and get its score. Without labels of both kinds every score is 0.5. Labels
that contradict each other for one id count as the lower one. An empty table gives no rows. Clashing input columns are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, bounded_sample, remainder, texts_of, without

PASSAGE, PAIRS, HIDDEN, GATE = 512, 768, 32, 16
#: Bounds of the training sample: documents a class, passages a document.
DOCS_A_CLASS, PASSAGES = 1_200, 24
LEAST_STEPS = 300
_SIZE = 256 + PAIRS
#: And how many kinds of pairs a passage has for its length, and its length.
_INPUTS = _SIZE + 2


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of PASSAGE bytes (the last of a text is filled with zeros) and the text each belongs to."""
    n = np.maximum(1, -(-np.array([len(t) for t in texts], np.int64) // PASSAGE))
    raw = b"".join(t + b"\0" * (int(k) * PASSAGE - len(t)) for t, k in zip(texts, n))
    return np.frombuffer(raw, np.uint8).reshape(-1, PASSAGE), np.repeat(np.arange(len(texts)), n)


def features(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each byte and of each hashed byte pair in a passage, its variety and its length;
    filler counts as nothing."""
    n, codes = len(raw), raw.astype(np.int32)
    at = (np.arange(n, dtype=np.int32) * _SIZE)[:, None]
    pair = 256 + (codes[:, :-1] * 31 + codes[:, 1:] * 7919 ^ codes[:, 1:] >> 2) % PAIRS
    # a pair with a filler byte goes to byte 0's place, which is cleared below
    pair[(raw[:, :-1] == 0) | (raw[:, 1:] == 0)] = 0
    counts = np.bincount((at + codes).ravel(), minlength=n * _SIZE) + np.bincount((at + pair).ravel(), minlength=n * _SIZE)
    x = counts.reshape(n, _SIZE).astype(np.float32)
    x[:, 0] = 0
    length = x[:, :256].sum(axis=1)
    kinds = (x[:, 256:] > 0).sum(axis=1) / np.maximum(1, np.sqrt(length) * 16)
    x = np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))
    return np.column_stack([x, kinds.astype(np.float32), (length / PASSAGE).astype(np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        shapes = {"w": (_INPUTS, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "o": (1,)}
        self.p = {k: rng.normal(0, (2 / s[0]) ** 0.5 if len(s) > 1 else 0.1, s).astype(np.float32) for k, s in shapes.items()}
        self.fitted = False

    def _forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["w"] * 4 + p["b"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["a"]
        e = np.exp(np.clip(e, -20, 20))
        a = e / np.bincount(owner, e, n)[owner]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, owner, a[:, None] * h)
        return h, v, u, a, z, _sigmoid(z @ p["c"] + p["o"][0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        raw, owner = passages(texts)
        e, h = [], []
        p = self.p
        for i in range(0, len(raw), 256):  # so many passages fit a processor's cache
            g = np.tanh(features(raw[i : i + 256]) @ p["w"] * 4 + p["b"])
            e.append((np.tanh(g @ p["v"]) * _sigmoid(g @ p["u"])) @ p["a"])
            h.append(g)
        e, h, n = np.exp(np.clip(np.concatenate(e), -20, 20)), np.concatenate(h), len(texts)
        a = e / np.bincount(owner, e, n)[owner]
        starts = np.searchsorted(owner, np.arange(n))
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["o"][0]).astype(float)

    def train(self, raw: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 24, rate: float = 4e-3, seed: int = 5) -> Network:
        """raw: passages sorted by owner; y: the label of each owner."""
        x, n = np.concatenate([features(raw[i : i + 1024]) for i in range(0, len(raw), 1024)]), len(y)
        rng, m, s, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        first = np.searchsorted(owner, np.arange(n + 1))
        epochs = max(epochs, LEAST_STEPS * 64 // n)  # few labels are seen more often
        for _ in range(epochs):
            for docs in np.array_split(rng.permutation(n), max(1, n // 64)):
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                xb, p = x[rows], self.p
                h, v, u, a, z, out = self._forward(xb, own, len(docs))
                d = (out - y[docs]) / len(docs)
                dz = d[:, None] * p["c"]
                dh = a[:, None] * dz[own]
                da = (h * dz[own]).sum(axis=1)
                de = a * (da - np.bincount(own, a * da, len(docs))[own])
                dvu = de[:, None] * p["a"]
                dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
                dh = (dh + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
                g = {"w": 4 * xb.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ de, "c": z.T @ d, "o": np.array([d.sum()])}
                t += 1
                for k in p:
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] * (1 - 1e-4) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.fitted = True
        return self


def sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> list:
    """(quality, passages) of a bounded number of labelled documents, in the order of a hash of their id."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(remainder("doc_id") != 1)
    here = docs.select("doc_id").join(known, "doc_id").distinct()
    chosen = bounded_sample(here, "quality", DOCS_A_CLASS, 4).select("doc_id", "quality")  # two classes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = []
            for t in texts_of(b.column("text")):
                raw = passages([t.encode("utf-8", "replace")])[0]
                raws.append(raw[np.unique(np.linspace(0, len(raw) - 1, PASSAGES).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(raws, pa.binary())], names=["doc_id", "quality", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    # of several rows with one id the one whose passages sort first, so the sample is bounded and always the same
    one = rows.mapInArrow(cut, f"doc_id {kind}, quality int, raw binary").groupBy("doc_id", "quality").agg(F.min("raw").alias("raw"))
    return sorted((r.quality, bytes(r.raw)) for r in one.collect())


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Network:
    """Trained only on rows whose crc32(doc_id) mod 3 is not 1."""
    rows, net = sample(docs, labels, text), Network()
    if len({q for q, _ in rows}) == 2:
        raw = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, PASSAGE) for _, b in rows])
        owner = np.repeat(np.arange(len(rows)), [len(b) // PASSAGE for _, b in rows])
        net.train(raw, owner, np.array([q for q, _ in rows], float))
    return net


def score(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The table with score (0 to 1; higher: quality 1 likelier) and predicted (1 if score >= 0.5)."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out, block, size = [], [], 0
        for t in texts_of(texts):
            block.append(t.encode("utf-8", "replace"))
            size += len(t)
            if size >= 1 << 20:  # bounded memory
                out.append(net.scores(block))
                block, size = [], 0
        if block:
            out.append(net.scores(block))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    out = df.withColumn("_s", scored.asNondeterministic()(text))
    return out.select(*without(out, "score", "predicted", "_s").columns, F.col("_s").alias("score"), (F.col("_s") >= 0.5).cast("int").alias("predicted"))
