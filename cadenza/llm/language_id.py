"""Language of a text by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, all of them. Bytes are embedded, filters of several widths
run over each window, each filter's largest response passes a rectifier, and a softmax gives the languages. The windows'
probabilities, weighted by their bytes, give the document's. The network is trained in numpy, with gradients through
the largest response, on windows of labelled texts.

A null text, or one without any letter, gets `und` and score 0, and so does every text where no labelled text was there to
learn from. Ties go to the language that sorts first. An empty
table gives no rows. Clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, bounded_sample, remainder, without

WINDOW, EMBEDDED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
#: Bounds of the training sample: documents a language, documents in all, windows a document.
DOCS_A_LANGUAGE, DOCS, WINDOWS = 400, 6_400, 12
LEAST_STEPS = 150
_LETTER = regex.compile(r"\p{L}")
_K = max(WIDTHS)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (rows of WINDOW bytes, the last of a text filled with zeros), their text and bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    raw = np.frombuffer(b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    used = np.full(len(owner), WINDOW)
    last = np.cumsum(n)[n > 0] - 1
    used[last] = ((sizes - 1) % WINDOW + 1)[n > 0]
    return raw, owner, used


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        f = FILTERS * len(WIDTHS)
        self.mask = np.zeros((_K * EMBEDDED, f), np.float32)  # a narrower filter leaves its last places at 0
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBEDDED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBEDDED)), "w": rng.normal(0, 0.3, self.mask.shape) * self.mask, "b": np.zeros(f),
            "d": rng.normal(0, 0.2, (f, max(1, len(languages)))), "c": np.zeros(max(1, len(languages))),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _responses(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses (windows, places, filters) and the embedded places they come from."""
        e = self.p["e"][raw]
        n = WINDOW - _K + 1
        x = np.concatenate([e[:, i : i + n] for i in range(_K)], axis=2)
        return (x.reshape(-1, x.shape[2]) @ self.p["w"]).reshape(len(raw), n, -1), x

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(raw), 64):  # so many windows fit a processor's cache
            top = self._responses(raw[i : i + 64])[0].max(axis=1)
            out.append(np.maximum(top + self.p["b"], 0) @ self.p["d"] + self.p["c"])
        z = np.concatenate(out) if out else np.zeros((0, len(self.p["c"])), np.float32)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, raw: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 4e-3, seed: int = 11) -> Network:
        rng, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        share = np.bincount(y, minlength=len(self.p["c"])).clip(1)
        weight = (len(y) / (share * len(share)))[y].astype(np.float32)
        epochs = max(epochs, LEAST_STEPS * 128 // len(raw))  # a small sample is seen more often
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // 128)):
                r, x = self._responses(raw[at])
                best = r.argmax(axis=1)
                top = np.take_along_axis(r, best[:, None], axis=1)[:, 0] + self.p["b"]
                h = np.maximum(top, 0)
                z = h @ self.p["d"] + self.p["c"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(at)), y[at]] -= 1
                z *= weight[at, None] / len(at)
                dtop = (z @ self.p["d"].T) * (top > 0)
                src = np.take_along_axis(x, best[:, :, None], axis=1)  # (windows, filters, places of a filter)
                g = {"d": h.T @ z, "c": z.sum(axis=0), "b": dtop.sum(axis=0), "w": np.einsum("nfk,nf->kf", src, dtop, optimize=True) * self.mask}
                dx = dtop[:, :, None] * self.p["w"].T[None]
                ge = np.zeros_like(self.p["e"])
                for j in range(_K):
                    np.add.at(ge, np.take_along_axis(raw[at], best + j, axis=1).ravel(), dx[:, :, j * EMBEDDED : (j + 1) * EMBEDDED].reshape(-1, EMBEDDED))
                g["e"], t = ge, t + 1
                for k in self.p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def sample(docs: DataFrame, text: str = "text", lang: str = "lang") -> list:
    """(lang, windows) of a bounded number of labelled documents, in the order of a hash of their id."""
    can = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.coalesce(remainder("doc_id"), F.lit(0)) != 1))
    chosen = bounded_sample(can.select("doc_id", F.col(lang).alias("lang")), "lang", DOCS_A_LANGUAGE, 5).orderBy("k", "h", "lang").limit(DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, raws = [], [], []
            for i, l, t in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if _LETTER.search(t):
                    raw = windows([t.encode("utf-8", "replace")])[0]
                    at = np.unique(np.linspace(0, len(raw) - 1, WINDOWS).astype(int))
                    ids.append(i)
                    langs.append(l)
                    raws.append(raw[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(langs, pa.string()), pa.array(raws, pa.binary())], names=["doc_id", "lang", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most DOCS rows of an id and a language
    picked = can.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    # of several rows with one id and language the one whose windows sort first, so the sample is always the same
    one = picked.select("doc_id", "lang", "text").mapInArrow(cut, f"doc_id {kind}, lang string, raw binary").groupBy("doc_id", "lang").agg(F.min("raw").alias("raw"))
    return sorted((r.lang, bytes(r.raw)) for r in one.collect())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Network:
    rows = sample(docs, text, lang)
    net = Network(sorted({r[0] for r in rows}))
    if rows:
        raw = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(-1, WINDOW) for r in rows])
        y = np.concatenate([np.full(len(r[1]) // WINDOW, net.languages.index(r[0])) for r in rows])
        net.train(raw, y)
    return net


def classify(texts: list[str | None], net: Network) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    have = [i for i, t in enumerate(texts) if t and net.languages and _LETTER.search(t)]
    block, size = [], 0
    for k, i in enumerate(have):
        block.append(i)
        size += len(texts[i])
        if size >= 1 << 20 or k + 1 == len(have):  # bounded memory
            raw, owner, used = windows([texts[j].encode("utf-8", "replace") for j in block])
            p = net.probabilities(raw) * used[:, None]
            total = np.zeros((len(block), p.shape[1]))
            np.add.at(total, owner, p)
            total /= total.sum(axis=1, keepdims=True)
            for j, row in zip(block, total):
                names[j], scores[j] = net.languages[int(row.argmax())], float(min(1.0, row.max()))
            block, size = [], 0
    return names, scores


def identify(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The table with lang_pred and score."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = classify(texts.to_pylist(), net)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    out = df.withColumn("_p", predicted.asNondeterministic()(text))
    return out.select(*without(out, "lang_pred", "score", "_p").columns, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))
