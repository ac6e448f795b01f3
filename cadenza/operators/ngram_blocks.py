"""Perplexity under the trigram model of a whole corpus, without a row for each n-gram.

It is what ngram.estimate(), backoff() and perplexity() give together. These shuffle every n-gram as a row of strings,
several times the size of the texts. Here a task counts the n-grams of a piece of text, sorts them and sends each block
(by a word's hash) one compressed body: the words that the body uses once, and columns of their numbers. Three steps
follow each other, and what a text is asked goes through them with the counts that it has met:

1. by the middle word: counts of trigrams, pairs and contexts;
2. by the last word: its count, and how likely the followers of a word are;
3. by the middle word again: the score.

Every text is counted in full. Only contexts and words that nobody asks for are left out after step 1. The work of words
of more than PIECE tokens is dealt to several blocks by the other word; what is known of such a word goes to each.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import LOG_ZERO
from cadenza.functions.shared import written
from cadenza.operators.ngram import DISCOUNT

#: Bytes of text that are counted at once; tokens that a block holds; blocks at least; tokens of a word in one block.
TEXT_BYTES, BLOCK, LEAST_BLOCKS, PIECE = 16 << 20, 2_000_000, 24, 500_000
#: Upper bound of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20
#: Stands for a null key, which Arrow's numbers cannot hold.
NO_KEY = -(1 << 63)
BEGIN, END = "<s>", "</s>"
BODIES = "block int, then int, kind string, body binary"
_BODIES = pa.schema([("block", pa.int32()), ("then", pa.int32()), ("kind", pa.string()), ("body", pa.binary())])
_LEVEL = 3  # of zstd


@dataclass(frozen=True)
class Deal:
    """Which block holds a word; `pieces` are the words that lie in several."""

    blocks: int
    pieces: dict[str, int]

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of pieces) of each word, and of no word behind them."""
        texts = words.to_pylist()
        return np.array([*(zlib.crc32(w.encode()) for w in texts), 0], np.int64), np.array([*(min(self.pieces.get(w, 1), self.blocks) for w in texts), 1], np.int64)

    def block(self, dealt: tuple[np.ndarray, np.ndarray], word: np.ndarray, other: np.ndarray) -> np.ndarray:
        code, pieces = dealt
        return (code[word] + code[other] % pieces[word]) % self.blocks

    def every(self, dealt: tuple[np.ndarray, np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks in which the rows' words lie."""
        code, pieces = dealt
        row = np.repeat(np.arange(len(word)), pieces[word])
        return row, (code[word[row]] + np.arange(len(row)) - np.repeat(np.cumsum(pieces[word]) - pieces[word], pieces[word])) % self.blocks


# --- texts to numbers ---------------------------------------------------------------------------------------------
def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of strings without null."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)


def _strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def sentence_numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, their numbers, tokens of each text) of lower-case texts: <s>, the words [a-z]+, </s>. Bytes of
    other letters are above z in UTF-8, so they part words as any other sign."""
    at, data = _bytes_of(texts)
    letter = (data >= 97) & (data <= 122)
    edge = np.zeros(len(data) + 1, bool)  # a word never reaches into the next text
    edge[at] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    begin = np.flatnonzero(begins)
    words = _strings(np.flatnonzero(ends) - begin + 1, data[letter]).dictionary_encode()
    del letter, edge, begins, ends
    size = np.diff(np.searchsorted(begin, at)) + 2
    names = pa.concat_arrays([words.dictionary, pa.array([BEGIN, END])])
    order = pc.sort_indices(names).to_numpy()
    number = np.empty(len(names), np.int32)
    number[order] = np.arange(len(names))
    ids = np.full(size.sum(), number[-2])
    last = np.cumsum(size) - 1
    inner = np.ones(len(ids), bool)
    inner[last], inner[last - size + 1] = False, False
    ids[inner], ids[last] = number[words.indices.to_numpy()], number[-1]
    return names.take(pa.array(order)), ids, size


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a text, in batches of some TEXT_BYTES of it (or one longer text)."""
    held, room = [], TEXT_BYTES
    for b in batches:
        b = b.filter(pc.is_valid(b["text"]))
        at, first = _bytes_of(b["text"])[0], 0
        while first < b.num_rows:
            end = max(first + 1, int(np.searchsorted(at, at[first] + room, "right")) - 1)
            held.append(b.slice(first, end - first))
            room -= at[end] - at[first]
            if room <= 0 or end < b.num_rows:
                yield pa.concat_batches(held)
                held, room = [], TEXT_BYTES
            first = end
    if held:
        yield pa.concat_batches(held)


# --- bodies -------------------------------------------------------------------------------------------------------
def _small(a: np.ndarray) -> tuple:
    """Numbers of 0 and more in as few bytes as the largest needs, the bytes of one place together."""
    a = a.astype(np.min_scalar_type(a.max()) if len(a) and a.min() >= 0 else np.int64)
    return a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _large(dtype: str, n: int, data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(dtype).reshape(n).astype(np.int64) if n else np.empty(0, np.int64)


def _body(words: pa.Array, named: list[np.ndarray], counts: list[np.ndarray], key: np.ndarray | None = None) -> bytes:
    """Columns of word numbers (-1: none), of counts, and an ascending key. Only the words that occur are in it."""
    used = np.flatnonzero(np.bincount(np.concatenate(named) + 1, minlength=len(words) + 1)[1:])
    number = np.full(len(words) + 1, len(used))
    number[used] = np.arange(len(used))
    at, data = _bytes_of(words.take(pa.array(used)))
    steps = [] if key is None else [_small(np.diff(key)), int(key[0])]
    raw = pickle.dumps((_small(np.diff(at)), data.tobytes(), [_small(number[x]) for x in named], [_small(x) for x in counts], steps), 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", _LEVEL).compress(raw, asbytes=True)


def _open(bodies: list[bytes]) -> tuple[pa.Array, dict[int, tuple[list[np.ndarray], list[np.ndarray], np.ndarray | None]]]:
    """(words, by place in the list: columns as given to _body, numbered by these words)."""
    found = [pickle.loads(pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)) for b in bodies]
    names = [_strings(_large(*x[0]), np.frombuffer(x[1], np.uint8)) for x in found]
    every = pa.concat_arrays([*names, pa.array([], pa.string())]).dictionary_encode()
    number, first, out = every.indices.to_numpy(), 0, {}
    for i in range(len(found)):
        (_, _, named, counts, steps), found[i] = found[i], None
        own = np.append(number[first : first + len(names[i])], np.int32(-1))
        first += len(names[i])
        key = np.concatenate([[steps[1]], _large(*steps[0])]).cumsum() if steps else None
        out[i] = [own[_large(*x)] for x in named], [_large(*x) for x in counts], key
    return every.dictionary, out


def _dealt(kind: str, block: np.ndarray, words: pa.Array, named: list[np.ndarray], counts: list[np.ndarray], key: np.ndarray | None = None, then: np.ndarray | None = None) -> list[tuple]:
    """A row for each block, or each pair of blocks where `then` is where the body is sent on to."""
    to = block if then is None else then
    order = np.argsort(to, kind="stable") if key is None else np.lexsort((key, to))
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    take = lambda x, part: None if x is None else x[part]
    return [(int(block[p[0]]), int(to[p[0]]), kind, _body(words, [x[p] for x in named], [x[p] for x in counts], take(key, p))) for p in np.split(order, cuts) if len(p)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BODIES)], schema=_BODIES)


def _kinds(t: pa.Table) -> tuple[pa.Array, dict[str, tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]]:
    """(words, by kind: the columns of all bodies of it)."""
    kinds = t["kind"].to_pylist()
    words, found = _open(t["body"].to_pylist())
    out = {}
    for kind in set(kinds):
        own = [found.pop(i) for i, k in enumerate(kinds) if k == kind]
        joined = [[np.concatenate(x) for x in zip(*[o[i] for o in own], strict=True)] for i in (0, 1)]
        out[kind] = joined[0], joined[1], np.concatenate([o[2] for o in own]) if own[0][2] is not None else None
    return words, out


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)


def _found(table: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of keys in an ascending table, else 0."""
    if not len(table):
        return np.zeros(len(at), np.int64)
    i = np.minimum(np.searchsorted(table, at), len(table) - 1)
    return np.where(table[i] == at, values[i], 0)


def _trigram_keys(n: int, *rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key of w2 w3, key of w2 w3 w1) of each (w1, w2, w3) with numbers below n; a pair's trigrams follow each other."""
    pairs = [w2.astype(np.int64) * (n + 1) + w3 for _, w2, w3 in rows]
    if (n + 1) ** 3 >= 1 << 63:
        every = np.unique(np.concatenate(pairs))
        pairs = [np.searchsorted(every, p) for p in pairs]
    return [(p, p * (n + 1) + w[0] + 1) for p, w in zip(pairs, rows, strict=True)]


# --- the steps ----------------------------------------------------------------------------------------------------
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _pieces(batches):
        words, ids, _ = sentence_numbers(t["text"])
        yield pa.record_batch({"w": words, "c": np.bincount(ids, minlength=len(words))})


def _trigrams(t: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, w1, w2, w3) of each word after <s>, w1 is -1 for the first; how many each row has."""
    words, ids, size = sentence_numbers(t["text"])
    begin = np.zeros(len(ids), bool)
    begin[np.cumsum(size) - size] = True
    last = np.flatnonzero(~begin)
    w1 = np.where(begin[last - 1], np.int32(-1), ids[last - 2])
    return words, w1, ids[last - 1], ids[last], size - 1


def _count(deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            words, w1, w2, w3, _ = _trigrams(t)
            key = _trigram_keys(len(words), [w1, w2, w3])[0][1]
            order = np.argsort(key)
            first = _runs(key[order])
            r, c = order[first], np.diff(first, append=len(order))
            del key, order, first
            w1, w2, w3 = w1[r], w2[r], w3[r]
            yield _rows(_dealt("grams", deal.block(deal.of(words), w2, w3), words, [w1, w2, w3], [c]))

    return run


def _ask(deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            words, w1, w2, w3, size = _trigrams(t)
            yield _rows(_dealt("asked", deal.block(deal.of(words), w2, w3), words, [w1, w2, w3], [], np.repeat(t["key"].to_numpy(), size)))

    return run


def _words_of_model(deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = b["w"].cast(pa.string())
                row, block = deal.every(deal.of(words), np.arange(len(words)))
                yield _rows(_dealt("words", block, words, [row], [b["c"].to_numpy()[row]]))

    return run


def _first(deal: Deal):
    """By the middle word. Out: asked with its counts and pairs, both by the last word, and contexts, which are sent on."""

    def run(t: pa.Table) -> pa.Table:
        here = t["block"][0].as_py()
        words, of = _kinds(t)
        none = np.empty(0, np.int64)
        (w1, w2, w3), (c,), _ = of.pop("grams", ([none] * 3, [none], None))
        (a1, a2, a3), _, key = of.pop("asked", ([none] * 3, [], none))
        n, dealt = len(words), deal.of(words)
        (_, tri), (asked_pair, asked_tri) = _trigram_keys(n, [w1, w2, w3], [a1, a2, a3])
        order = np.argsort(tri)
        tri = tri[order]
        first = _runs(tri)
        r = order[first]
        c3 = np.add.reduceat(c[order], first) if len(first) else none
        tri, w1, w2, w3 = tri[first], w1[r], w2[r], w3[r]
        del order, r, c
        pair = tri // (n + 1)
        first = _runs(pair)
        c2 = np.add.reduceat(c3, first) if len(first) else none
        of_pair = np.repeat(c2, np.diff(first, append=len(pair)))
        rows = []
        if len(key):
            counts = [np.where(a1 >= 0, _found(tri, c3, asked_tri), 0), _found(pair[first], c2, asked_pair)]
            rows += _dealt("asked", deal.block(dealt, a3, a2), words, [a1, a2, a3], counts, key)
        # words in several blocks may be asked for in another one
        spread, wanted = dealt[1][:-1] > 1, np.zeros(n, bool)
        wanted[a2] = True
        p = first[(wanted | spread)[w2[first]]]
        rows += _dealt("pairs", deal.block(dealt, w3[p], w2[p]), words, [w2[p], w3[p]], [of_pair[p]])
        context = w2.astype(np.int64) * (n + 1) + w1 + 1
        k = np.flatnonzero((w1 >= 0) & (spread[w2] | np.isin(context, np.unique(a2.astype(np.int64) * (n + 1) + a1 + 1))))
        k = k[np.argsort(context[k], kind="stable")]
        first = _runs(context[k])
        if len(first):
            r = k[first]
            sums = [np.add.reduceat(x[k], first) for x in (c3, np.ones_like(c3), of_pair)]
            then = deal.block(dealt, w2[r], w1[r])
            rows += _dealt("contexts", np.full(len(r), here), words, [w1[r], w2[r]], sums, None, then)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _second(deal: Deal):
    """By the last word. Out: asked with the word's count, sums over the followers of words, and the contexts, all by the
    middle word."""

    def run(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_pylist()
        rows = [(x["then"], x["then"], "contexts", x["body"]) for x in t.filter(pa.array([k == "contexts" for k in kind])).to_pylist()]
        words, of = _kinds(t.filter(pa.array([k != "contexts" for k in kind])))
        dealt, c1 = deal.of(words), np.zeros(len(words), np.int64)
        if "words" in of:
            (w,), (c,), _ = of["words"]
            c1[w] = c
        if "pairs" in of:
            (w2, w3), (c2,), _ = of["pairs"]
            order = np.argsort(w2, kind="stable")
            first = _runs(w2[order])
            w, sums = w2[order[first]], [np.add.reduceat(x[order], first) for x in (c2, np.ones_like(c2), c1[w3])]
            row, block = deal.every(dealt, w)
            rows += _dealt("followed", block, words, [w[row]], [x[row] for x in sums])
        if "asked" in of:
            (a1, a2, a3), (c3, c2), key = of["asked"]
            rows += _dealt("asked", deal.block(dealt, a2, a1), words, [a1, a2], [c3, c2, c1[a3]], key)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _weight(kinds, total, seen):
    """log10 of what discounting leaves over, spread over the words that were not seen."""
    return np.log10(np.maximum(DISCOUNT * kinds / total, 1e-12) / np.maximum(1 - seen, 1e-12))


def _third(deal: Deal, tokens: int):
    """By the middle word: sums of scores by key."""

    def run(t: pa.Table) -> pa.Table:
        words, of = _kinds(t)
        n, none = len(words), np.empty(0, np.int64)
        if "asked" not in of:
            return pa.table({"key": none, "words": none, "oov": none, "logp": none.astype(float)})
        (a1, a2), (c3, c2, c1), key = of["asked"]
        followed = np.zeros((3, n), np.int64)
        if "followed" in of:
            (w,), sums, _ = of["followed"]
            for i, x in enumerate(sums):
                np.add.at(followed[i], w, x)
        (w1, w2), sums, _ = of.get("contexts", ([none] * 2, [none] * 3, None))
        at, asked_at = (b.astype(np.int64) * (n + 1) + a + 1 for a, b in ((w1, w2), (a1, a2)))
        order = np.argsort(at)
        first = _runs(at[order])
        sums = [np.add.reduceat(x[order], first) if len(first) else none for x in sums]
        total3, kinds3, pairs3 = (_found(at[order[first]], x, asked_at) for x in sums)
        total2, kinds2, words2 = (x[a2] for x in followed)
        begin = pc.index(words, BEGIN).as_py()
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(c1 > 0, np.log10(c1 / tokens), LOG_ZERO)
            weight = np.where((total2 > 0) & (a2 != begin), _weight(kinds2, total2, words2 / tokens), 0.0)
            p = np.where(c2 > 0, np.log10((c2 - DISCOUNT) / total2), weight + p)
            weight = np.where(total3 > 0, _weight(kinds3, total3, (pairs3 - DISCOUNT * kinds3) / total2), 0.0)
            p = np.where(c3 > 0, np.log10((c3 - DISCOUNT) / total3), weight + p)
        order = np.argsort(key, kind="stable")
        first = _runs(key[order])
        known = c1 > 0
        by = lambda x: np.add.reduceat(x[order], first)
        return pa.table({"key": key[order[first]], "words": by(np.ones_like(key)), "oov": by((~known).astype(np.int64)), "logp": by(np.where(known, p, 0.0))})

    return run


def corpus_perplexity(corpus: DataFrame, text: str, asked: DataFrame, key: str, asked_text: str, block: int = BLOCK, piece: int = PIECE, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(key, words, oov, logp, perplexity) of the texts of `asked`, with an integer key, as ngram.perplexity() gives them
    under the trigram model of ngram.estimate() over all texts of `corpus`. Null texts have no words."""
    corpus.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    lower = lambda df, name, *more: df.select(F.lower(F.col(name)).alias("text"), *more)
    texts, questions = lower(corpus, text), lower(asked, asked_text, F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"))
    each = lambda df, own: df.select("text").mapInArrow(_word_counts, "w string, c long").select("w", *[F.when(F.lit(own == x), F.col("c")).otherwise(0).alias(x) for x in ("c", "a")])
    counts = written(each(texts, "c").unionByName(each(questions, "a")).groupBy("w").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "words")
    both: Column = F.col("c") + F.col("a")
    tokens, total = counts.agg(F.coalesce(F.sum(F.when(F.col("w") != BEGIN, F.col("c"))), F.lit(0)), F.coalesce(F.sum(both), F.lit(0))).first()
    frequent = counts.where(both > piece).select("w", F.ceil(both / piece).cast("int")).collect()  # total / piece words at most
    deal = Deal(max(least_blocks, -(-total // block)), dict(map(tuple, frequent)))
    grams = texts.mapInArrow(_count(deal), BODIES).unionByName(questions.mapInArrow(_ask(deal), BODIES))
    one = grams.groupBy("block").applyInArrow(_first(deal), BODIES)
    words = counts.where("c > 0").select("w", "c").mapInArrow(_words_of_model(deal), BODIES)
    two = one.unionByName(words).groupBy("block").applyInArrow(_second(deal), BODIES)
    parts = two.groupBy("block").applyInArrow(_third(deal, tokens), "key long, words long, oov long, logp double")
    out = parts.groupBy(F.nullif(F.col("key"), F.lit(NO_KEY)).alias(key)).agg(F.sum("words").alias("words"), F.sum("oov").alias("oov"), F.sum("logp").alias("logp"))
    out = out.withColumn("logp", F.when(F.col("words") > F.col("oov"), F.col("logp")))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("logp") / (F.col("words") - F.col("oov"))))
