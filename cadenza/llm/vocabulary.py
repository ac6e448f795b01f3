"""Reading of public tokenizer files and byte-pair merging; each Python worker loads a file once."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex

#: Chunks whose result a worker remembers, characters that they may have on average, and the longest chunk that is
#: remembered at all; beyond that those not met lately are forgotten, so memory is bounded whatever the script and spacing
#: of texts (a result takes at most 16 bytes a character).
MEMO, MEMO_CHARS, LONGEST = 500_000, 16, 128
END_OF_WORD = "</w>"
#: Python counts these four as white space, the tokenizers library does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: These, and all beyond Latin Extended-B.
_LEFT_TO_LIBRARY = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")
#: The word vocabulary's pattern, for ASCII and for Latin letters.
_WORD_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_WORD_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    """The tokenizers library's own object, with truncation and padding off."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_path(name))
    out.no_truncation()
    out.no_padding()
    return out


def definition(name: str) -> dict:
    with open(tokenizer_path(name), encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the
    others follow from U+0100 in order."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def merge_ranks(d: dict) -> dict[tuple[str, str], int]:
    return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(d["model"]["merges"])}


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: again and again join the leftmost pair of the best rank. Long inputs use a heap, so that the
    time stays near linear."""
    if len(parts) > 48:
        return _merge_long(parts, ranks)
    rank = [ranks.get(p, 1 << 30) for p in zip(parts, parts[1:])]
    while rank:
        best = min(rank)
        if best == 1 << 30:
            break
        i = rank.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get((parts[i - 1], parts[i]), 1 << 30)
        if i < len(rank):
            rank[i] = ranks.get((parts[i], parts[i + 1]), 1 << 30)
    return parts


def _merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p[0], p[1]) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    parts = list(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has been joined with another meanwhile
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (parts[i], parts[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, *p))
        h = before[i]
        if h >= 0 and (p := (parts[h], parts[i])) in ranks:
            heapq.heappush(heap, (ranks[p], h, *p))
    return [p for p in parts if p is not None]


class WordSplitter:
    """Pre-tokens of a vocabulary with word ends (lower case, NFC, white space dropped), in its byte letters.

    Up to Latin Extended-B two patterns give the same pre-tokens as the library and faster; beyond, and for the control
    characters on which the two differ, the library itself splits. Special strings come out as they are.
    """

    def __init__(self, name: str):
        self.library = library(name)
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.special = {t["content"]: t["id"] for t in definition(name)["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def pretokens(self, chunk: str) -> list[str]:
        if "<|" in chunk:
            return [w for p in self.at_special.split(chunk) if p for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(chunk)

    def _plain(self, part: str) -> list[str]:
        if part.isascii():
            low = part.lower()
            if low.isalpha():
                return [low]
            if low.isprintable():  # printable ASCII stands for itself
                return _WORD_ASCII.findall(low)
            if not SEPARATORS.search(part):
                return [w.translate(self.letters) for w in _WORD_ASCII.findall(low)]
        elif not _LEFT_TO_LIBRARY.search(part):
            low, letters = unicodedata.normalize("NFC", part).lower(), self.letters
            found = (low,) if low.isalpha() else _WORD_LATIN.findall(low)
            return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in found]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]


class Memo(dict):
    """What a function gave for each key, in two generations of half of `most` keys, or of `chars` characters a key. A full
    generation takes the older one's place; a key met again comes back from there, so frequent keys are never lost.
    Keys longer than LONGEST are computed each time: texts without blanks hardly repeat."""

    def __init__(self, make, most: int = MEMO, chars: int = MEMO_CHARS):
        self.make, self.most, self.chars, self.held, self.older = make, most // 2, most // 2 * chars, 0, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if (n := len(key)) <= LONGEST:
            self.held += n
            if len(self) >= self.most or self.held > self.chars:
                self.older = dict(self)
                self.clear()
                self.held = n
            self[key] = out
        return out


def as_struct(fields: dict) -> pa.StructArray:
    return pa.StructArray.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in fields.values()], names=list(fields))
