"""License scan by patience alignment.

Text and license templates are lower-cased words. Around each place where a text has rare words of a template, a window
is aligned with it: words that are unique both in the window and in the template anchor the alignment, the longest
increasing subsequence of anchors is kept, and the gaps between anchors are aligned in the same way; a gap without
common unique words is aligned by its longest common subsequence. Coverage is the share of the template's words that
are matched; windows of at least COVERAGE are findings.

A notice may be spread out: its matched words lie within a stretch of the text that is longer than the notice by SPREAD
of its words, SLACK words at least. Words beyond that are never matched, so a notice with more words inserted than that
is not found. The window around a rare word is first cut close (SLACK words on both sides of where the notice would lie
unbroken) and only if that does not give the whole notice as wide as SPREAD allows. Before the first anchor words are
matched as late, behind the last anchor as early as possible, and without anchors in the shortest stretch, so a verbatim
notice has coverage 1 whatever words surround it.

Only texts that hold a rare word of a template are aligned: a template's rare words are chosen so that they make up more
than 1 - COVERAGE of it, so a text without any cannot reach COVERAGE. Of overlapping findings the one with the most
matched words stays (then the higher coverage, the earlier place, the name).

Null, empty and word-less texts have no findings: an empty list and null for the best. Every row gives one row; an
empty table gives none. Clashing input columns are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, texts_of, without

COVERAGE, SLACK, SPREAD = 0.8, 4, 1.0
#: Public license notices: (license, wording).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
]
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, of pairs in the order of their first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        tails[i : i + 1] = [j]
        at[i : i + 1] = [k]
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str], i0: int, j0: int) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two short gaps."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _shortest(a: list[str], b: list[str], i0: int, j0: int) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence in the shortest stretch of a."""
    best, at = (0, 0), 0  # matched words and, smaller is better, the stretch
    row = [(0, 0)] * (len(b) + 1)  # for each prefix of b: matched words of a so far and their latest possible start
    for i, x in enumerate(a):
        new = [(0, i + 1)]
        for j, y in enumerate(b):
            here = max(row[j + 1], new[j])
            if x == y:
                n, start = row[j]
                here = max(here, (n + 1, start if n else i))
            new.append(here)
        row = new
        n, start = row[-1]
        if n and (n, start - i) > best:
            best, at = (n, start - i), i
    if not best[0]:
        return []
    start = at + best[1]
    return _common(a[start : at + 1], b, i0 + start, j0)


def align(text: list[str], template: list[str], i0: int = 0, j0: int = 0, edges: tuple[bool, bool] = (True, True)) -> list[tuple[int, int]]:
    """Matched (place in text, place in template) by patience alignment, in order. edges: whether the text's begin and end
    are open, that is, no anchor stands beside them."""
    if not text or not template:
        return []
    a, b = Counter(text), Counter(template)
    places = {w: j for j, w in enumerate(template) if b[w] == 1}
    anchors = _increasing([(i, places[w]) for i, w in enumerate(text) if a[w] == 1 and w in places])
    if not anchors:
        if a.keys().isdisjoint(b):
            return []
        if edges == (True, True):
            return _shortest(text, template, i0, j0)
        if edges == (True, False):  # as late as possible: the same from behind
            n, m = len(text), len(template)
            return [(i0 + n - 1 - i, j0 + m - 1 - j) for i, j in reversed(_common(text[::-1], template[::-1], 0, 0))]
        return _common(text, template, i0, j0)
    out, pi, pj = [], 0, 0
    for i, j in [*anchors, (len(text), len(template))]:
        out += align(text[pi:i], template[pj:j], i0 + pi, j0 + pj, (edges[0] and not pi and (i, j) == anchors[0], edges[1] and i == len(text)))
        if i < len(text):
            out.append((i0 + i, j0 + j))
        pi, pj = i + 1, j + 1
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], coverage: float, spread: float = SPREAD):
        self.coverage = coverage
        self.templates = [(name, words_of(t)) for name, t in templates]
        self.slack = [max(SLACK, int(spread * len(t))) for _, t in self.templates]
        #: words of each template that a finding matches at least; exact, as floats fall short
        self.least = [-int(-Fraction(str(coverage)) * len(t) // 1) for _, t in self.templates]
        often = Counter(w for _, t in self.templates for w in set(t))
        self.rare: dict[str, list[int]] = {}
        for k, (_, t) in enumerate(self.templates):
            count, left = Counter(t), len(t) - self.least[k] + 1
            for w in sorted(count, key=lambda w: (-len(w), often[w], w)):
                if left > 0:
                    self.rare.setdefault(w, []).append(k)
                    left -= count[w]
        #: the first and last place of a rare word in a template
        self.at = {(w, k): (t.index(w), len(t) - 1 - t[::-1].index(w)) for w, of in self.rare.items() for k in of for t in [self.templates[k][1]]}

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first and last + 1 word of the text), in order of place."""
        words = words_of(text)
        if self.rare.keys().isdisjoint(words):
            return []
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.rare.get(w, ()):
                hits.setdefault(k, []).append(i)
        found = []
        for k, places in hits.items():
            name, t = self.templates[k]
            end = 0
            for p in places:
                if p < end:  # within the last whole notice of this template
                    continue
                pairs = self._around(words, p, k, end)
                if pairs:
                    found.append((name, round(len(pairs) / len(t), 6), len(pairs), pairs[0][0], pairs[-1][0] + 1))
                    if len(pairs) == len(t):
                        end = pairs[-1][0] + 1
        return self._without_overlaps(found)

    def _around(self, words: list[str], p: int, k: int, begin: int) -> list[tuple[int, int]]:
        """The matched places of template k around a rare word at p, if they are enough; none before `begin`."""
        t, best = self.templates[k][1], []
        first, last = self.at[words[p], k]
        for slack in (SLACK, self.slack[k]):
            lo = max(begin, p - last - slack)
            window = words[lo : p - first + len(t) + slack]
            if sum((Counter(window) & Counter(t)).values()) < self.least[k]:
                continue
            pairs = _compact(align(window, t, lo), len(t) + slack)
            if len(pairs) > len(best):
                best = pairs
            if len(best) == len(t) or slack == self.slack[k]:
                break
        return best if len(best) >= self.least[k] else []

    @staticmethod
    def _without_overlaps(found: list) -> list:
        out: list = []  # in order of place
        for f in sorted(set(found), key=lambda f: (-f[2], -f[1], f[3], f[0])):
            i = bisect_left(out, f[3], key=lambda g: g[3])
            if (not i or out[i - 1][4] <= f[3]) and (i == len(out) or out[i][3] >= f[4]):
                out.insert(i, f)
        return out


def _compact(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The most matched places that lie within a span of the text; of equally many those in the shortest stretch."""
    best, found = (0, 0), (0, 0)
    lo = 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= span:
            lo += 1
        if (this := (hi + 1 - lo, pairs[lo][0] - pairs[hi][0])) > best:
            best, found = this, (lo, hi + 1)
    return pairs[found[0] : found[1]]


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES), coverage: float = COVERAGE, spread: float = SPREAD) -> Scanner:
    return Scanner(templates, coverage, spread)


_RESULT = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def scan_licenses(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """The table with n_findings, license and coverage of the best finding, and all `findings` in order of place."""
    bound_batches(df.sparkSession)
    fixed = tuple(map(tuple, templates))

    @F.arrow_udf("array<struct<license:string,coverage:double,matched:int,first_word:long,last_word:long>>")
    def scanned(texts: pa.Array) -> pa.Array:
        s, names = scanner(fixed, coverage, spread), [f.name for f in _RESULT]
        return pa.array([[dict(zip(names, f)) for f in s.scan(t)] for t in texts_of(texts)], pa.list_(_RESULT))

    out = df.withColumn("_f", scanned.asNondeterministic()(text))
    best = F.array_max(F.transform("_f", lambda f: F.struct(f["matched"], f["coverage"], f["license"])))
    kept = without(out, "n_findings", "license", "coverage", "findings", "_f").columns
    return out.select(*kept, F.size("_f").alias("n_findings"), best["license"].alias("license"), best["coverage"].alias("coverage"), F.col("_f").alias("findings"))
