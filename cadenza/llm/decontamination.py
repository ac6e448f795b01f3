"""Benchmark decontamination by template canonicalisation.

Text is cut into words; numbers, units and names become typed placeholders, so a question with other values has the
same template. Windows of WINDOW words are hashed and hash-joined with the benchmark's windows in three views: typed
(0), typed with every capitalised word as a name (1), and the plain lower-cased words (2), which upper-cased copies and
windows of few literals need. Matches on one diagonal (same distance between positions) are one alignment; so are all
matches on neighbouring diagonals, no further apart than the item is long, as inserted or deleted words leave them.
Its slots are checked for consistency: a value of the item must always stand for the same value of the document, while
two of its values may well be given the same new one. Where values conflict, the pair met at the most places stays (none
on a tie) and windows with another one are dropped; RUN words in a row must then remain, as a short item with conflicting
values is another question. Alignments
that cover COVERAGE of an item's words, or on one diagonal RUN words, are leaks: `exact` if every slot that stays is
equal, else `reparameterised`.

White space is normalised. A number is written in digits or in English words (a run of these is one number); a unit is a
unit word in any letter case after a number; a name is a capitalised word of any script that follows a word in lower case
and at most a comma, and in view 1 any capitalised word. An upper-cased copy is matched by its plain words. Items under
SHORT words are matched by windows of SHORT_WINDOW words, so that a changed word spoils less of them, and items shorter
than that as one window; items under MIN_WORDS are ignored, as are typed windows with fewer than LITERALS words that are
not placeholders (half of a short one). Null and empty texts never match; null ids are kept as they are. Repeated rows
give one result. Empty tables give no rows.

Windows that more than COMMON items share are boilerplate: unless an item's own would make a leak by themselves, they are
looked at only for documents that also hold another window of the item, without which there is no leak. So boilerplate
does not multiply documents by items. Windows that many documents hold are dealt to several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, materialize, spread_join

WINDOW, MIN_WORDS, LITERALS, COVERAGE, RUN = 8, 5, 4, 0.5, 13
SHORT, SHORT_WINDOW = 24, 5
#: Items that share a window up to which every document with it is compared with each of them at once.
COMMON = 64
#: Benchmark windows up to which two bit tables of them (4 MB) are sent to all tasks, to drop other windows before the join;
#: with more, the join alone does the work.
FILTERED = 4_000_000
#: Units by name, each with its short and long forms; and the English number words.
_UNIT_FORMS = """m metre metres meter meters|km kilometre kilometres kilometer kilometers|cm centimetre centimetres centimeter centimeters|mm millimetre millimetres millimeter millimeters
mile miles|foot feet|inch inches|yard yards|g gram grams|kg kilogram kilograms kilo kilos|mg milligram milligrams|lb lbs pound pounds|ounce ounces oz|ton tons tonne tonnes
l litre litres liter liters|ml millilitre millilitres milliliter milliliters|gallon gallons|s second seconds sec|ms millisecond milliseconds|minute minutes min|h hour hours|day days|week weeks
month months|year years|percent|dollar dollars|cent cents|euro euros|degree degrees|kph mph"""
UNITS = {w: forms.split()[0] for forms in _UNIT_FORMS.replace("\n", "|").split("|") for w in forms.split()}
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"hundred": 100, "thousand": 1_000, "million": 1_000_000}
#: Placeholders before a slot's value: private-use characters.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
TYPED, CAPITALS, PLAIN = 0, 1, 2
#: Kinds of words: digits, number words, units, sure names, and capitalised words that only view 1 takes for names.
DIGITS, SPELLED, A_UNIT, A_NAME, A_CAPITAL = 1, 2, 3, 4, 5
#: Characters that are cut into words at once.
BLOCK = 1 << 20
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(WINDOW)], np.uint64)
_PLACES = np.random.default_rng(7).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = 0x20000  # from here on there are ideographs, which have no case


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each character below _LAST, and what it is: 1 word, 2 digit, 4 white space, 8 upper and 16 lower
    case."""
    lower, kind = np.arange(_LAST + 1, dtype=np.uint32), np.zeros(_LAST + 1, np.uint8)
    for i in range(_LAST):
        c = chr(i)
        if len(low := c.lower()) == 1:
            lower[i] = ord(low)
        kind[i] = (c.isalnum() or c == "_") + 4 * c.isspace() + 8 * (c.isalpha() and c.isupper()) + 16 * (c.isalpha() and c.islower())
    kind[48:58] |= 2
    kind[_LAST] = 1
    return lower, kind


class Words:
    """The words of some texts as arrays: code (a hash of the lower-cased word), kind, first and past the last character
    (of all texts together), owner (which text). Numbers are words of their own even inside others, with points and commas
    between digits; runs of number words are one word."""

    def __init__(self, texts: list[str]):
        text, found, at, before = "\n".join(texts), [], 0, 0
        while at < len(text):
            stop = len(text)
            if stop - at > BLOCK and (m := _CUT.search(text, at + BLOCK)):
                stop = m.end()  # behind a word and before white space, so that no word or number is cut
            part, before = self._block(text[at:stop], at, before)
            found.append(part)
            at = stop
        self.code, self.kind, self.first, self.last, gap = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.owner = np.searchsorted(starts, self.first, "right") - 1
        same = np.concatenate([[False], self.owner[1:] == self.owner[:-1]])[: len(self.owner)]
        self.kind[~same & (self.kind == A_NAME)] = A_CAPITAL
        tagged = self.kind == SPELLED
        if tagged.any():
            again = tagged & np.concatenate([[False], tagged[:-1]]) & (gap == 1) & same
            kept = np.flatnonzero(~again)
            self.last = self.last[np.concatenate([kept[1:], [len(gap)]]) - 1]
            self.code, self.kind, self.first, self.owner, same = self.code[kept], self.kind[kept], self.first[kept], self.owner[kept], same[kept]
        after = np.flatnonzero((self.kind == DIGITS) | (self.kind == SPELLED)) + 1
        after = after[after < len(self.kind)]
        after = after[same[after] & ((self.kind[after] == 0) | (self.kind[after] == A_CAPITAL))]
        units = _vocabulary()[1]
        self.kind[after[np.fromiter((c in units for c in self.code[after].tolist()), bool, len(after))]] = A_UNIT
        self.text = text

    @staticmethod
    def _block(text: str, offset: int, before: int) -> tuple[tuple, int]:
        """The words of a part, and the kind of its last character; before is that of the character ahead of it."""
        lower, kinds = _characters()
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(raw, _LAST)
        kind = kinds[at]
        low = np.where(raw < _LAST, lower[at], raw)
        word, digit = (kind & 1).astype(bool), (kind & 2).astype(bool)
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = word[1:] != word[:-1]
        if digit.any():
            point = np.flatnonzero((raw == 44) | (raw == 46))
            point = point[(point > 0) & (point < len(raw) - 1)]
            point = point[digit[point - 1] & digit[point + 1]]
            word[point] = digit[point] = True  # points inside numbers
            cut[1:-1] = (word[1:] != word[:-1]) | (digit[1:] != digit[:-1])
        edge = np.flatnonzero(cut)
        first, last = edge[:-1], edge[1:]
        real = word[first] if len(raw) else np.empty(0, bool)
        first, last = first[real], last[real]
        if not len(first):
            return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))), int(kind[-1]) if len(kind) else before
        size = last - first
        off = np.cumsum(size) - size
        place = np.arange(off[-1] + size[-1]) - np.repeat(off, size)
        h = np.add.reduceat((low[word].astype(np.uint64) + np.uint64(1)) * _PLACES[place & 4095], off) + size.astype(np.uint64) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out = np.zeros(len(h), np.int64)
        # names: a capital, then lower case up to the word's end; sure behind a word in lower case and at most a comma
        head = np.flatnonzero((kind[first] & 8 > 0) & (size > 1))
        if len(head):
            small = np.concatenate([[0], np.cumsum(kind & 16 > 0)])
            name = head[(small[last[head]] - small[first[head] + 1] == size[head] - 1)]
            begins = (first[name] == 0) | ~word[np.maximum(first[name] - 1, 0)]
            ends = (last[name] == len(raw)) | ~word[np.minimum(last[name], len(raw) - 1)]
            name = name[begins & ends]
            white = np.concatenate([[0], np.cumsum(kind & 4 > 0)])
            end = np.where(name > 0, last[np.maximum(name - 1, 0)], 0)
            gap = first[name] - end
            spaces = white[first[name]] - white[end]
            comma = (gap - spaces == 1) & (raw[np.minimum(end, len(raw) - 1)] == 44)
            ahead = np.where(name > 0, kind[np.maximum(end - 1, 0)], before if before & 1 else 0)
            out[name] = np.where((spaces > 0) & ((gap == spaces) | comma) & (ahead & 16 > 0), A_NAME, A_CAPITAL)
        out[digit[first]] = DIGITS
        some, _, numbers = _vocabulary()
        maybe = np.flatnonzero(some[h >> np.uint64(48)])
        out[maybe[np.fromiter((c in numbers for c in h[maybe].tolist()), bool, len(maybe))]] = SPELLED
        return (h, out, first + offset, last + offset, np.concatenate([[1 << 30], first[1:] - last[:-1]])), int(kind[-1])

    def value(self, i: int) -> str:
        """A slot's placeholder and value."""
        k, w = int(self.kind[i]), self.text[self.first[i] : self.last[i]].lower()
        if k == SPELLED:
            return NUMBER + str(spelled(_LETTERS.findall(w)))
        return NUMBER + w if k == DIGITS else UNIT + UNITS[w] if k == A_UNIT else NAME + w


_CUT = re.compile(r"(?<=\w)(?=\s)")
_LETTERS = re.compile("[a-z]+")


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[np.ndarray, frozenset, frozenset]:
    """The codes of units and of number words, and a table of the first bits of the latter."""
    code = lambda w: int(_word_code(w))
    numbers = frozenset(map(code, NUMBERS))
    some = np.zeros(1 << 16, bool)
    some[[c >> 48 for c in numbers]] = True
    return some, frozenset(code(u) for u in UNITS if u.isalpha()), numbers


def _word_code(w: str) -> np.uint64:
    h = np.array([ord(c) + 1 for c in w], np.uint64) * _PLACES[: len(w)]
    h = np.add.reduce(h, keepdims=True) + np.uint64(len(w)) * _MIX[:1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32))[0]


#: What stands for a number, a unit and a name in typed windows.
_STAND_IN = np.array([0, 11, 11, 22, 33, 33], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def spelled(words: list[str]) -> int:
    """The number that a run of number words says."""
    total, part = 0, 0
    for w in words:
        n = NUMBERS[w]
        if n >= 1_000:
            total, part = total + max(part, 1) * n, 0
        else:
            part = max(part, 1) * n if n == 100 else part + n
    return total + part


def template(text: str) -> tuple[np.ndarray, dict[int, str], set[int]]:
    """A code for each lower-cased word, the slots (position to placeholder and value), and which of them are
    capitalised words that only view 1 takes for names."""
    w = Words([text])
    return w.code, {int(i): w.value(i) for i in np.flatnonzero(w.kind)}, set(np.flatnonzero(w.kind == A_CAPITAL).tolist())


def window_hashes(codes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash for each window of so many words, or for those that begin at the given places."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n if at is None else len(at), np.uint64)
    for j in range(size):
        h += (codes[j : j + n] if at is None else codes[at + j]) * _MIX[j]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)


def bit_tables(hashes: np.ndarray) -> np.ndarray:
    """Two tables of 2^24 bits, by different bits of the hashes: a window that is in neither is none of these."""
    out = np.zeros((2, 1 << 24), bool)
    out[0, hashes >> np.uint64(40)] = True
    out[1, hashes >> np.uint64(16) & np.uint64(0xFFFFFF)] = True
    return out


def _known(tables: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """The places whose hash the tables may hold."""
    if tables is None:
        return np.arange(len(h))
    at = np.flatnonzero(tables[0][h >> np.uint64(40)])
    return at[tables[1][h[at] >> np.uint64(16) & np.uint64(0xFFFFFF)]]


def _inside(marked: np.ndarray, size: int) -> np.ndarray:
    """How many of the marked words each window holds."""
    filled = np.concatenate([[0], np.cumsum(marked)])
    return filled[size:] - filled[:-size]


def _windows(w: Words, size: int, tables: np.ndarray | None):
    """(view, place, hash) of the windows of so many words that may match, within one text. Views 1 and 2 add only those
    in which they differ from view 0."""
    n, owner = len(w.code) - size + 1, w.owner
    if n <= 0:
        return
    whole = owner[:n] == owner[size - 1 :]
    least = LITERALS if size >= WINDOW else (size + 1) // 2
    sure = (w.kind > 0) & (w.kind != A_CAPITAL)
    slots, any_sure = _inside(sure, size), sure.any()
    codes = np.where(sure, _STAND_IN[w.kind], w.code) if any_sure else w.code
    h = window_hashes(codes, size)
    at = _known(tables, h)
    at = at[whole[at] & (size - slots[at] >= least)]
    yield TYPED, at, h[at]
    capitals = w.kind == A_CAPITAL
    if capitals.any():
        more = _inside(capitals, size)
        at = np.flatnonzero((more > 0) & whole & (size - slots - more >= least))
        h = window_hashes(np.where(capitals, _STAND_IN[A_CAPITAL], codes), size, at)
        known = _known(tables, h)
        yield CAPITALS, at[known], h[known]
    if any_sure:
        at = np.flatnonzero((slots > 0) & whole)
        h = window_hashes(w.code, size, at)
        known = _known(tables, h)
        yield PLAIN, at[known], h[known]


def _rows(key: list, texts: list[str | None], sizes: list[int], tables: np.ndarray | None, whole_items: bool) -> dict[str, list]:
    """The windows of some texts that may match; of items all windows of the size that their length asks for."""
    out: dict[str, list] = {"key": [], "pos": [], "size": [], "words": [], "hash": [], "view": [], "slots": []}
    have = [i for i, t in enumerate(texts) if t]
    w = Words([texts[i] for i in have])
    begin = np.searchsorted(w.owner, np.arange(len(have) + 1))
    n = np.diff(begin)
    own_size = np.minimum(n, np.where(n >= SHORT, WINDOW, SHORT_WINDOW)) if whole_items else None
    for size in sorted(set(own_size[n >= MIN_WORDS].tolist())) if whole_items else sizes:
        for view, at, hashes in _windows(w, size, tables):
            for p, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                i = int(w.owner[p])
                if n[i] < MIN_WORDS or whole_items and own_size[i] != size:
                    continue
                kinds = w.kind[p : p + size]
                slots = np.flatnonzero(kinds if view == CAPITALS else (kinds > 0) & (kinds != A_CAPITAL)).tolist()
                out["key"].append(key[have[i]])
                out["pos"].append(p - int(begin[i]))
                out["size"].append(size)
                out["words"].append(int(n[i]))
                out["hash"].append(h)
                out["view"].append(view)
                out["slots"].append([{"o": o, "v": w.value(p + o)} for o in slots])
    return out


def _resolved(matches: list[dict]) -> tuple[set[int], bool, bool]:
    """The item's words that windows without conflicting slots cover, whether slots conflicted, whether all are equal."""
    places: dict[tuple[str, str], set] = {}
    for m in matches:
        for s in m["pairs"]:
            places.setdefault((s["b"], s["d"]), set()).add((s["p"], s["p"] + m["diagonal"]))
    best: dict[str, list[int]] = {}
    for pair, met in places.items():
        best.setdefault(pair[0], []).append(len(met))
    conflict = any(len(n) > 1 for n in best.values())
    if conflict:
        best = {k: sorted(n, reverse=True) for k, n in best.items()}
        leads = lambda n, k: n == best[k][0] and (len(best[k]) == 1 or best[k][1] < n)
        places = {p: met for p, met in places.items() if leads(len(met), p[0])}
        matches = [m for m in matches if all((s["b"], s["d"]) in places for s in m["pairs"])]
    covered = {i for m in matches for i in range(m["bpos"], m["bpos"] + m["size"])}
    return covered, conflict, all(s["b"] == s["d"] for m in matches for s in m["pairs"])


def _longest(places: set[int]) -> int:
    """The most places in a row."""
    best = 0
    for i in places:
        if i - 1 not in places:
            n = 1
            while i + n in places:
                n += 1
            best = max(best, n)
    return best


def judge(words: int, matches: list[dict]) -> dict | None:
    """The best leak among the alignments of one item and one document, if any."""
    lines: dict[int, list[dict]] = {}
    for m in matches:
        lines.setdefault(m["diagonal"], []).append(m)
    found = [(ms, True) for ms in lines.values()]
    united: list[list[int]] = []
    for x in sorted(lines):
        if united and x - united[-1][-1] <= words:
            united[-1].append(x)
        else:
            united.append([x])
    found += [([m for x in xs for m in lines[x]], False) for xs in united if len(xs) > 1]
    best = None
    for ms, single in found:
        # by the sure names alone, with plain words, with all views: no view takes away what another one shows
        tried = None
        for views in ((TYPED,), (TYPED, PLAIN), (TYPED, CAPITALS, PLAIN)):
            some = [m for m in ms if m["view"] in views]
            if not some or tried == len(some):
                continue
            tried = len(some)
            covered, conflict, equal = _resolved(some)
            n = len(covered)
            if (not conflict or _longest(covered) >= RUN) and (n >= COVERAGE * words or single and n >= RUN):
                this = (n / words, n, equal)
                best = this if best is None else max(best, this)
    return best and {"coverage": best[0], "matched_words": best[1], "kind": "exact" if best[2] else "reparameterised"}


_SCHEMA = "pos long, size int, words long, hash long, view int, slots array<struct<o:int,v:string>>"
_ARROW = {"pos": pa.int64(), "size": pa.int32(), "words": pa.int64(), "hash": pa.int64(), "view": pa.int32(), "slots": pa.list_(pa.struct([("o", pa.int32()), ("v", pa.string())]))}


def template_windows(df: DataFrame, sizes: list[int], tables: np.ndarray | None = None, whole_items: bool = False) -> DataFrame:
    """One row per window of `key`'s text that may match: key, pos, size, words (of the text), hash, view, slots."""
    kind = df.schema["key"].dataType.simpleString()
    packed = None if tables is None else df.sparkSession.sparkContext.broadcast(np.packbits(tables, axis=1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if packed is None else np.unpackbits(packed.value, axis=1).view(bool)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = _rows(part.column("key").to_pylist(), part.column("text").to_pylist(), sizes, bits, whole_items)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], b.schema.field("key").type), *[pa.array(rows[k], t) for k, t in _ARROW.items()]], names=["key", *_ARROW])

    return df.select("key", "text").mapInArrow(cut, f"key {kind}, {_SCHEMA}")


def _suffice(common: DataFrame) -> DataFrame:
    """Items (bk) whose common windows alone could make a leak: they cover enough words, or a run of RUN."""
    at = common.select("bk", "bwords", "size", "bpos").distinct()
    w = Window.partitionBy("bk").orderBy("bpos")
    gap = F.col("bpos") - F.lag("bpos").over(w)
    at = at.withColumn("new", F.least(F.coalesce(gap, F.col("size")), F.col("size"))).withColumn("run", F.sum(F.when(F.coalesce(gap, F.lit(1 << 30)) > F.col("size"), 1).otherwise(0)).over(w))
    runs = at.groupBy("bk", "bwords", "run").agg(F.sum("new").alias("n"))
    return runs.groupBy("bk", "bwords").agg(F.sum("n").alias("n"), F.max("n").alias("longest")).where((F.col("n") >= COVERAGE * F.col("bwords")) | (F.col("longest") >= RUN)).select("bk")


def _matches(d: DataFrame, b: DataFrame) -> DataFrame:
    """(dk, bk, bwords, m) for the windows of documents that equal windows of items; m holds each match once, however
    many repeated rows have it."""
    pair = lambda o, x, y: F.struct((F.col("bpos") + o).alias("p"), x.alias("b"), y.alias("d"))
    view = F.greatest("bview", "dview")
    # plain words are equal, so whatever either side takes for a slot is
    pairs = F.when(view == PLAIN, F.transform(F.concat("bslots", "dslots"), lambda s: pair(s["o"], s["v"], s["v"]))).otherwise(F.zip_with("bslots", "dslots", lambda x, y: pair(x["o"], x["v"], y["v"])))
    match = F.struct((F.col("dpos") - F.col("bpos")).alias("diagonal"), "bpos", "size", view.alias("view"), pairs.alias("pairs")).alias("m")
    counts = d.groupBy("hash", "size").agg(F.count("*").alias("n"))
    total, key = d.count(), ["hash", "size"]

    def joined(rows: DataFrame, windows: DataFrame) -> DataFrame:
        return spread_join(rows, windows.join(counts, key), key, total).select("dk", "bk", "bwords", match)

    common = b.groupBy(*key).agg(F.count_distinct("bk").alias("items")).where(F.col("items") > COMMON).select(*key)
    if common.isEmpty():
        return joined(d, b)
    shared = b.join(common, key, "left_semi")
    enough = _suffice(shared)
    own = b.join(common, key, "left_anti").unionByName(shared.join(enough, "bk", "left_semi"))
    first = materialize(joined(d, own), "matches")
    rest = shared.join(enough, "bk", "left_anti")
    asked = first.select("dk", "bk").distinct()
    held = d.join(common, key, "left_semi")
    # the document's common windows for each of the items asked about, then those that the item has
    of = asked.join(held, "dk").join(rest, ["bk", *key]).select("dk", "bk", "bwords", match)
    return first.unionByName(of)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, coverage, matched_words, kind for each document and benchmark item that it leaks."""
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.struct("item_id", F.col("text").alias("t")).alias("key"), F.col("text").alias("text")).distinct()
    items = template_windows(items.select(F.struct("key.item_id", F.xxhash64("text").alias("th")).alias("key"), "text"), [], whole_items=True)
    items = materialize(items.distinct(), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # between MIN_WORDS and WINDOW
    tables = None
    if items.count() <= FILTERED:
        tables = bit_tables(items.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))
    source = docs.select(F.struct("doc_id", F.xxhash64(F.col(text)).alias("th")).alias("key"), F.col(text).alias("text"))
    found = materialize(template_windows(source, sizes, tables), "windows")
    d = found.select(F.col("key").alias("dk"), F.col("pos").alias("dpos"), "size", "hash", F.col("view").alias("dview"), F.col("slots").alias("dslots"))
    b = items.select(F.col("key").alias("bk"), F.col("pos").alias("bpos"), "size", "hash", F.col("view").alias("bview"), F.col("words").alias("bwords"), F.col("slots").alias("bslots"))
    met = _matches(d, b)

    @F.arrow_udf("struct<coverage:double,matched_words:int,kind:string>")
    def judged_by(words: pa.Array, matches: pa.Array) -> pa.Array:
        return pa.array([judge(w, ms) for w, ms in zip(words.to_pylist(), matches.to_pylist())], pa.struct([("coverage", pa.float64()), ("matched_words", pa.int32()), ("kind", pa.string())]))

    judged = met.groupBy("dk", "bk", "bwords").agg(F.collect_set("m").alias("ms")).select("dk", "bk", judged_by.asNondeterministic()("bwords", "ms").alias("r")).where("r is not null").select("dk", "bk", "r.*")
    best = judged.groupBy("dk", "bk.item_id").agg(F.max(F.struct("coverage", "matched_words", F.when(F.col("kind") == "exact", 1).otherwise(0).alias("e"), "kind")).alias("m"))
    return best.select("dk.doc_id", F.col("dk.th").alias("text_hash"), "item_id", F.round("m.coverage", 6).alias("coverage"), F.col("m.matched_words").alias("matched_words"), F.col("m.kind").alias("kind"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    found = materialize(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("l.text_hash"))
    return docs.alias("d").join(found.alias("l"), same, "left_anti")
