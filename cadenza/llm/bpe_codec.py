"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one last token that the merge rules can leave there. An automaton
over the vocabulary lists the tokens that are suffixes of each prefix; a token is the right one if it is compatible
with the unique last token of the prefix before it, that is, if merging the two side by side would keep the border.
The last tokens are stored for all prefixes and back-pointers give the ids. Time is linear in the text.

A null text is encoded as the empty text: no ids, empty decoded text. Special strings inside texts become their
special id, as is the library's default. Input columns that clash with the result's names are replaced.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, texts_of, without
from cadenza.llm.vocabulary import SEPARATORS, Memo, as_struct, byte_letters, definition, library

VOCABULARY = "byte_bpe_50k.json"
#: Pieces, pre-tokens and pairs of tokens that a worker remembers at most; each memo then starts anew.
PIECES, WORDS, PAIRS = 300_000, 150_000, 300_000
#: The vocabulary's pattern, for ASCII and for Latin letters.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside a blank, at either end, or of a kind on which the libraries differ: the whole text is split at once.
_UNEVEN = re.compile("^[ \x1c-\x1f]|[ \x1c-\x1f]$| \\s|\\s |[\x1c-\x1f]")


class Codec:
    def __init__(self, name: str):
        d = definition(name)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = {t: bytes(map(byte_of.__getitem__, t)) for t in d["model"]["vocab"]}
        ids = d["model"]["vocab"]
        self.name = name
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for m in d["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, t = (ids[a], ids[b]), ids[a + b]
            self.joined[pair] = t
            self.halves.setdefault(t, pair)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(raw[t].decode("latin-1"), (i, len(raw[t])))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        #: packed ids of pre-tokens, and of the pieces between single blanks, where a blank before a piece belongs to it
        self.words = Memo(lambda p: array("I", self.pretoken(p)).tobytes(), WORDS)
        self.first, self.later = Memo(self.plain, 10_000), Memo(lambda piece: self.plain(" " + piece), PIECES)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave a border between these two tokens.

        Undoes merges from the latest to the earliest around the border: if two neighbours there form a token that
        would have been merged before the merges still in place, the border would be gone.
        """
        limit, joined, halves = 1 << 30, self.joined, self.halves
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                if a in halves:
                    limit, a = a, halves[a][1]
                    continue
                limit = b + 1
                if b not in halves:
                    return True
                b = halves[b][0]
            else:
                if b in halves:
                    limit, b = b + 1, halves[b][0]
                    continue
                limit = a
                if a not in halves:
                    return True
                a = halves[a][1]

    def pretoken(self, text: str) -> list[int]:
        """The ids of one pre-token: for each prefix its unique last token, then back from the end."""
        key = text if text.isascii() else text.encode().decode("latin-1")
        fits = self.fits
        last: list[int] = [0] * len(key)
        size: list[int] = [0] * len(key)
        at = -1
        for end, (token, n) in self.automaton.iter(key):
            if end == at:
                continue  # this prefix has its token
            before = end - n
            if before >= 0:
                pair = last[before] << 20 | token
                if (ok := fits.get(pair)) is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    ok = fits[pair] = self.compatible(last[before], token)
                if not ok:
                    continue
            last[end], size[end], at = token, n, end
        out, end = [], len(key) - 1
        while end >= 0:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return out

    def plain(self, text: str) -> bytes:
        """The packed ids of a text without special strings."""
        if text[1:].isalpha() and text[0] == " " and max(text) < "\u0250":
            return self.words[text]
        uneven = SEPARATORS.search(text)
        if text.isascii() and not uneven:
            found = _ASCII.findall(text)
        elif max(text) < "ɐ" and not uneven:
            found = _LATIN.findall(text)
        else:  # rarer scripts, or separators that only Python takes for white space: the library decides
            back = {c: b for b, c in enumerate(byte_letters())}
            found = [bytes(map(back.__getitem__, p)).decode("utf-8") for p, _ in library(self.name).pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" in text and self.split_special:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._segment(p) for p in self.split_special.split(text) if p)
        return self._segment(text)

    def _segment(self, text: str) -> bytes:
        if _UNEVEN.search(text):
            return self.plain(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with `ids`: the token ids of each whole text as packed little-endian unsigned 32-bit integers."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        c = codec(vocabulary)
        return pa.array([c.encode(t) for t in texts_of(texts)], pa.binary())

    return without(df.withColumn("_i", encoded.asNondeterministic()(text)), "ids").withColumnRenamed("_i", "ids")


def decode(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with `decoded`: the text of packed ids, special tokens included."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("string")
    def decoded(packed: pa.Array) -> pa.Array:
        c = codec(vocabulary)
        return pa.array([c.decode(np.frombuffer(b or b"", "<u4")) for b in packed.to_pylist()], pa.string())

    return without(df.withColumn("_d", decoded.asNondeterministic()(ids)), "decoded").withColumnRenamed("_d", "decoded")


def round_trip(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """encode() and decode() in one pass through a Python worker: the table with `ids` and `decoded`."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(vocabulary)
        ids = [c.encode(t) for t in texts_of(texts)]
        return as_struct({"ids": pa.array(ids, pa.binary()), "decoded": pa.array([c.decode(np.frombuffer(b, "<u4")) for b in ids], pa.string())})

    out = df.withColumn("_r", both.asNondeterministic()(text))
    kept = without(out, "ids", "decoded", "_r").columns
    return out.select(*kept, F.col("_r.ids").alias("ids"), F.col("_r.decoded").alias("decoded"))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of what round_trip() gives."""
    return df.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
