"""Finite automata: arcs(src, label, dst), states(id, accept), terms(cat, wid). State 0 is initial. Automata read a
sentence from its last word to its first.

Queries over arcs are joins. Determinising, minimising and compiling are work on one grammar and run on the driver.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_dfa(lines, keep_zero_arcs: bool = True) -> tuple[list[tuple[int, int, int]], dict[int, bool]]:
    """Arcs and accept flags of `state label next statusHex` lines; bit 0 of the status is accept. With keep_zero_arcs
    off, an arc with label 0 to state 0 is dropped, as the classic reader does."""
    arcs, accept = [], {}
    for line in lines:
        f = line.split("#", 1)[0].split()
        if len(f) < 3:
            continue
        s, label, to = map(int, f[:3])
        accept[s] = accept.get(s, False) or bool(len(f) > 3 and int(f[3], 16) & 1)
        if label > 0 or to > 0 or (keep_zero_arcs and label >= 0 and to >= 0):
            arcs.append((s, label, to))
            accept.setdefault(to, False)
    return arcs, accept


# --- joins --------------------------------------------------------------------------------------------------------
def first_words(arcs: DataFrame, terms: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(wid, cat, state) for the arcs that leave state 0, of active grammars only if given (gram)."""
    a = arcs.where("src = 0")
    if active is not None:
        a = a.join(active.select("gram"), "gram", "left_semi")
    return a.join(terms, F.col("label") == F.col("cat")).select("wid", "cat", F.col("dst").alias("state")).distinct()


def next_words(states: DataFrame, arcs: DataFrame, terms: DataFrame, pause: int | None = None) -> DataFrame:
    """(hyp, wid, cat, state, can_insert_pause): words that may follow; a pause arc is looked through one step."""
    step = states.join(arcs, F.col("state") == F.col("src")).select("hyp", "label", F.col("dst").alias("state"))
    direct = step.where(F.col("label") != pause) if pause is not None else step
    out = direct.withColumn("can_insert_pause", F.lit(False))
    if pause is not None:
        through = step.where(F.col("label") == pause).select("hyp", F.col("state").alias("s"))
        beyond = through.join(arcs, F.col("s") == F.col("src")).where(F.col("label") != pause).select("hyp", "label", F.col("dst").alias("state"), F.lit(True).alias("can_insert_pause"))
        out = out.unionByName(beyond)
    return out.join(terms, F.col("label") == F.col("cat")).select("hyp", "wid", "cat", "state", "can_insert_pause").distinct()


def acceptable(states: DataFrame, flags: DataFrame) -> DataFrame:
    return states.join(flags.select(F.col("id").alias("state"), "accept"), "state", "left").withColumn("accept", F.coalesce("accept", F.lit(False)))


def category_pairs(arcs: DataFrame, pause: int | None = None) -> DataFrame:
    """(c1, c2): category c1 may come directly before c2 in the sentence, also across one pause arc."""
    a, b = arcs.alias("a"), arcs.alias("b")
    pairs = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("b.label").alias("c1"), F.col("a.label").alias("c2"))
    if pause is not None:
        p = arcs.where(F.col("label") == pause).alias("p")
        across = a.join(p, F.col("a.dst") == F.col("p.src")).join(b, F.col("p.dst") == F.col("b.src")).where((F.col("a.label") != pause) & (F.col("b.label") != pause))
        pairs = pairs.unionByName(across.select(F.col("b.label").alias("c1"), F.col("a.label").alias("c2")))
    return pairs.distinct()


def begin_categories(arcs: DataFrame, flags: DataFrame) -> DataFrame:
    """Categories that may begin a sentence: arcs into accepting states."""
    return arcs.join(flags.where("accept"), F.col("dst") == F.col("id"), "left_semi").select(F.col("label").alias("cat")).distinct()


def end_categories(arcs: DataFrame) -> DataFrame:
    return arcs.where("src = 0").select(F.col("label").alias("cat")).distinct()


def pause_categories(terms: DataFrame, words: DataFrame, pause: str = "sp") -> DataFrame:
    """Categories with a word of nothing but the pause phone."""
    return terms.join(words.where(F.forall("phones", lambda p: p == pause)), "wid", "left_semi").select("cat").distinct()


def merge(grammars: list[tuple[str, DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple]]:
    """One automaton of (name, arcs, flags, terms): states, categories and words are moved behind those before, initial
    states become one. Also gives the offsets (name, states, categories, words)."""
    arcs = flags = terms = None
    offsets, so, co, wo = [], 0, 0, 0
    for name, a, f, t in grammars:
        move = lambda c, so=so: F.when(F.col(c) == 0, 0).otherwise(F.col(c) + so)
        a2 = a.select(F.lit(name).alias("gram"), move("src").alias("src"), (F.col("label") + co).alias("label"), move("dst").alias("dst"))
        f2 = f.select(F.lit(name).alias("gram"), move("id").alias("id"), "accept")
        t2 = t.select(F.lit(name).alias("gram"), (F.col("cat") + co).alias("cat"), (F.col("wid") + wo).alias("wid"))
        arcs, flags, terms = (a2, f2, t2) if arcs is None else (arcs.unionByName(a2), flags.unionByName(f2), terms.unionByName(t2))
        offsets.append((name, so, co, wo))
        so += f.agg(F.max("id")).first()[0]
        co += t.agg(F.max("cat")).first()[0] + 1
        wo += t.agg(F.max("wid")).first()[0] + 1
    return arcs, flags, terms, offsets


def owner(ids: DataFrame, offsets: list[tuple[str, int, int]], column: str) -> DataFrame:
    """Which grammar owns a category or word: offsets (name, first, past the last)."""
    gram = F.lit(None).cast("string")
    for name, first, last in offsets:
        gram = F.when((F.col(column) >= first) & (F.col(column) < last), name).otherwise(gram)
    return ids.withColumn("gram", gram)


def look_around(words: DataFrame, trellis: DataFrame, reach: int) -> DataFrame:
    """Candidates (stream, hyp, wid, t0) that the trellis (stream, wid, end_t) holds within +-reach frames, with the
    nearest frame, earlier first."""
    w = words.withColumn("band", F.explode(F.array(*[F.floor(F.col("t0") / reach) + i for i in (-1, 0, 1)])))
    j = w.join(trellis.withColumn("band", F.floor(F.col("end_t") / reach)), ["stream", "wid", "band"]).where(F.abs(F.col("end_t") - F.col("t0")) <= reach)
    near = F.struct(F.abs(F.col("end_t") - F.col("t0")), "end_t")
    return j.groupBy("stream", "hyp", "wid", "t0").agg(F.min_by("end_t", near).alias("end_t"))


def accept(sentences: DataFrame, arcs: DataFrame, flags: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """Whether sentences (key, pos from the last word on, cats: the categories that the word may have) are accepted.

    The set of reachable states is folded over a sentence's words; arcs of a grammar are few and enter as one map. With
    compat any sentence that can be consumed counts as accepted.
    """
    step = defaultdict(list)
    for r in arcs.select("src", "label", "dst").collect():  # one grammar
        step[(r.src, r.label)].append(r.dst)
    good = [r.id for r in flags.where("accept").select("id").collect()]
    moves = F.create_map(*[x for (s, c), d in sorted(step.items()) for x in (F.lit(f"{s},{c}"), F.array(*map(F.lit, sorted(set(d)))))]) if step else F.lit(None).cast("map<string,array<int>>")

    def move(states, word):
        to = F.flatten(F.transform(states, lambda s: F.flatten(F.transform(word["cats"], lambda c: F.coalesce(F.element_at(moves, F.concat_ws(",", s, c)), F.array().cast("array<int>"))))))
        return F.array_distinct(to)

    rows = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "cats"))).alias("words"))
    reached = F.aggregate("words", F.array(F.lit(0)), move)
    ok = F.size("reached") > 0 if compat else F.exists("reached", lambda s: s.isin(*good))
    return rows.withColumn("reached", reached).select(key, "reached", ok.alias("accepted"))


def following_categories(reached: DataFrame, arcs: DataFrame, key: str) -> DataFrame:
    """Categories that may follow the states reached by a prefix."""
    s = reached.select(key, F.explode("reached").alias("src"))
    return s.join(arcs, "src").select(key, F.col("label").alias("cat")).distinct()


def minimise_round(arcs: DataFrame, groups: DataFrame) -> DataFrame:
    """One round of partition refinement (id, grp): states of one group with equal signatures stay together."""
    out = arcs.join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("to")), "dst")
    sig = out.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "label", "to"))), ",").alias("sig"))
    j = groups.join(sig, "id", "left").withColumn("sig", F.coalesce("sig", F.lit("")))
    return j.select("id", F.concat_ws("|", F.col("grp").cast("string"), "sig").alias("sig"), "grp")


# --- one grammar on the driver ------------------------------------------------------------------------------------
def determinise(arcs: list[tuple[int, int, int]], accepting: set[int], initial: set[int] = frozenset({0})) -> tuple[list[tuple[int, int, int]], dict[int, bool]]:
    """Subset construction; the new state 0 is the initial set."""
    step = defaultdict(lambda: defaultdict(set))
    for s, c, d in arcs:
        step[s][c].add(d)
    ids, todo, out = {frozenset(initial): 0}, [frozenset(initial)], []
    while todo:
        now = todo.pop()
        to = defaultdict(set)
        for s in now:
            for c, d in step[s].items():
                to[c] |= d
        for c in sorted(to):
            f = frozenset(to[c])
            if f not in ids:
                ids[f] = len(ids)
                todo.append(f)
            out.append((ids[now], c, ids[f]))
    return sorted(out), {i: bool(f & accepting) for f, i in ids.items()}


def minimise(arcs: list[tuple[int, int, int]], accept: dict[int, bool]) -> tuple[list[tuple[int, int, int]], dict[int, bool]]:
    """Merges states that no word tells apart, until the partition is stable."""
    group = {s: 0 if a else 1 for s, a in accept.items()}
    while True:
        sig = {s: (group[s], tuple(sorted((c, group[d]) for x, c, d in arcs if x == s))) for s in accept}
        order = {k: i for i, k in enumerate(sorted(set(sig.values()), key=lambda k: min(s for s in accept if sig[s] == k)))}
        new = {s: order[sig[s]] for s in accept}
        if len(set(new.values())) == len(set(group.values())):
            break
        group = new
    flags = {}
    for s, a in accept.items():
        flags[new[s]] = flags.get(new[s], False) or a
    return sorted({(new[s], c, new[d]) for s, c, d in arcs}), flags


def generate(arcs: list[tuple[int, int, int]], accept: dict[int, bool], number: int, seed: int, most: int = 100, give_up: int = 300) -> list[tuple[int, ...]]:
    """Distinct random sentences in reading order; stops after give_up repeats in a row."""
    rng, found, again = random.Random(seed), {}, 0
    step = defaultdict(list)
    for s, c, d in arcs:
        step[s].append((c, d))
    while len(found) < number and again < give_up:
        s, out = 0, []
        while len(out) < most:
            if accept.get(s) and (not step[s] or rng.random() < 0.5):
                break
            if not step[s]:
                break
            c, s = rng.choice(step[s])
            out.append(c)
        sentence = tuple(reversed(out))
        if not accept.get(s) or sentence in found:
            again += 1
        else:
            found[sentence], again = True, 0
    return list(found)


class GrammarError(ValueError):
    pass


def compile_grammar(text: str, start: str = "S") -> tuple[list[tuple[int, int, int]], dict[int, bool], list[str]]:
    """BNF rules `A : B C` to a minimal deterministic automaton that reads from the last word: (arcs, accept flags,
    category names). Symbols without a rule are categories. Rules may recur at one end only (regular grammars)."""
    rules: dict[str, list[list[str]]] = defaultdict(list)
    for line in text.splitlines():
        line = re.sub(r"[#%].*$", "", line).strip()
        if line:
            head, body = line.split(":", 1)
            rules[head.strip()].append(body.split())
    if start not in rules:
        raise GrammarError(f"no rule for {start}")
    names: dict[str, int] = {}
    arcs: list[tuple[int, int | None, int]] = []
    count = [2]

    def fresh() -> int:
        count[0] += 1
        return count[0] - 1

    def build(symbol: str, src: int, dst: int, path: dict[str, int]) -> None:
        # sentences are read backwards: a rule that recurs does so in its last read place, its first symbol
        if symbol not in rules:
            arcs.append((src, names.setdefault(symbol, len(names)), dst))
            return
        if symbol in path:
            raise GrammarError(f"{symbol} recurs inside a rule")
        entry = fresh()
        arcs.append((src, None, entry))
        for body in rules[symbol]:
            at = entry
            for k, s in enumerate(reversed(body)):
                last = k == len(body) - 1
                if s == symbol:
                    if not last:
                        raise GrammarError(f"{symbol} may recur only as its first symbol")
                    arcs.append((at, None, entry))
                    break
                to = dst if last else fresh()
                build(s, at, to, path | {symbol: entry})
                at = to
            if not body:
                arcs.append((entry, None, dst))

    build(start, 0, 1, {})
    empty = defaultdict(set)
    for s, c, d in arcs:
        if c is None:
            empty[s].add(d)

    def closure(states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for d in empty[todo.pop()] - out:
                out.add(d)
                todo.append(d)
        return out

    every = {s for a in arcs for s in (a[0], a[2])}
    plain = [(s, c, d) for x in every for s in [x] for y in closure({x}) for (z, c, d) in arcs if z == y and c is not None]
    good = {s for s in every if 1 in closure({s})}
    a, f = determinise(plain, good)
    a, f = minimise(a, f)
    return a, f, sorted(names, key=names.get)


def reverse_grammar(text: str) -> str:
    """The same rules with their symbols in the opposite order."""
    return "\n".join(f"{h.strip()} : {' '.join(reversed(b.split()))}" for h, b in (x.split(":", 1) for x in text.splitlines() if ":" in x))


def reversed_automaton(arcs: list[tuple[int, int, int]], accept: dict[int, bool]) -> tuple[list[tuple[int, int, int]], dict[int, bool]]:
    """The deterministic automaton that reads sentences in the opposite direction."""
    back = [(d, c, s) for s, c, d in arcs]
    return determinise(back, {0}, {s for s, a in accept.items() if a})


class GrammarSet:
    """Grammars that are added, deleted, activated and deactivated; requests take effect at update(), at a safe point."""

    def __init__(self):
        self.live: dict[int, dict] = {}
        self.version, self._wait, self._next = 0, [], 0

    def add(self, name: str, arcs, accept, terms) -> int:
        gid, self._next = self._next, self._next + 1
        self._wait.append(("add", gid, {"name": name, "arcs": arcs, "accept": accept, "terms": terms, "active": True}))
        return gid

    def request(self, what: str, gid: int) -> None:
        if what not in ("delete", "activate", "deactivate"):
            raise ValueError(what)
        self._wait.append((what, gid, None))

    def add_words(self, gid: int, terms) -> None:
        self._wait.append(("words", gid, terms))

    def update(self) -> bool:
        """Applies what waits; True if the lexicon has to be built anew."""
        rebuild = False
        for what, gid, body in self._wait:
            if what == "add":
                self.live[gid] = body
            elif gid not in self.live:
                continue
            elif what == "delete":
                del self.live[gid]
            elif what == "words":
                self.live[gid]["terms"] = [*self.live[gid]["terms"], *body]
            else:
                self.live[gid]["active"] = what == "activate"
            rebuild |= what in ("add", "delete", "words")
        self._wait.clear()
        self.version += rebuild
        return rebuild

    def active(self) -> list[int]:
        return [g for g, x in self.live.items() if x["active"]]
