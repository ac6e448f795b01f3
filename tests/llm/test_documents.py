"""License scan, decontamination, near duplicates and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontamination as C
from cadenza.llm import license_scan as L
from cadenza.llm import near_duplicates as N


# --- licenses -----------------------------------------------------------------------------------------------------
def test_patience_alignment():
    t = "a b c d e f".split()
    assert L.align("x a b y c d z e f".split(), t) == [(1, 0), (2, 1), (4, 2), (5, 3), (7, 4), (8, 5)]
    assert L.align("b b a".split(), "a b b".split()) == [(2, 0)]  # the one unique word anchors
    assert len(L.align("a a b".split(), "a a c".split())) == 2  # no unique word in common: longest common subsequence
    assert L.align([], t) == [] and L._increasing([(0, 3), (1, 1), (2, 2), (3, 5)]) in ([(1, 1), (2, 2), (3, 5)],)
    rnd = random.Random(1)
    for _ in range(200):
        a, b = [rnd.choice("abcdefgh") for _ in range(12)], [rnd.choice("abcdefgh") for _ in range(9)]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(L._common(a, b, 0, 0))


def test_licenses(spark, docs, nothing):
    mit = dict((n, t) for n, t in L.TEMPLATES if len(t) > 200)["MIT"]
    filler = "under the version of this or and a to license work " * 40
    rows = [(0, f"{filler} Licensed under the Apache License, Version 2.0. {filler}", 1), (1, mit.upper().replace(" ", "\n"), 1), (2, filler, 0), (3, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!! more text. Released under the MIT License.", 2), (4, " ".join(mit.split()[:20]), 0), (5, mit.replace("merge, publish, ", ""), 1), (6, None, 0), (7, "", 0)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    assert {i: got[i].n_findings for i, _, _ in rows} == {i: n for i, _, n in rows}
    assert (got[0].license, got[0].coverage, got[1].license, got[5].license) == ("Apache-2.0", 1.0, "MIT", "MIT") and got[5].coverage < 1
    f = got[0].findings[0]
    assert L.words_of(rows[0][1])[f.first_word : f.last_word] == "licensed under the apache license version 2 0".split()
    odd = L.scan_licenses(docs)
    assert odd.count() == docs.count() and odd.columns.count("license") == 1 and L.scan_licenses(nothing).count() == 0


def test_rare_words_never_hide_a_finding():
    s = L.scanner()
    rnd = random.Random(2)
    for name, t in s.templates:
        for _ in range(20):
            kept = sorted(rnd.sample(range(len(t)), -(-int(s.coverage * 1000) * len(t) // 1000)))
            assert not s.rare.keys().isdisjoint([t[i] for i in kept]), name


def test_own_rare_words_never_hide_a_finding():
    s = L.scanner()
    for k, (name, t) in enumerate(s.templates):
        rare = {w for w, of in s.rare.items() if k in of}
        most_without = sum(w not in rare for w in t)
        assert most_without * 10 < 8 * len(t), name
    for text in ("Distributed under the MIT License", "Available under the MIT License."):
        assert [f[:3] for f in s.scan(text)] == [("MIT", 0.8, 4)]


def test_verbatim_notices_in_any_surroundings():
    """Each notice amid words drawn from all notices: whole coverage, its own name, its own place."""
    s, rnd = L.scanner(), random.Random(10)
    pool = [w for _, t in s.templates for w in t]
    for k, (name, t) in enumerate(s.templates):
        for _ in range(60):
            before, after = ([rnd.choice(pool) for _ in range(40)] for _ in range(2))
            found = s.scan(" ".join([*before, *t, *after]))
            over = [f for f in found if f[3] < 40 + len(t) and f[4] > 40]
            # another notice that holds this one, or as many words by chance, may stand in its place
            assert any(f[2] >= len(t) for f in over), (name, found)
            if len(t) > 12:
                assert any(f[0] == name and f[1] == 1.0 and f[4] - f[3] == len(t) for f in over), (name, found)


def test_notices_with_inserted_words():
    s, rnd = L.scanner(), random.Random(11)
    for k, (name, t) in enumerate(s.templates):
        for _ in range(10):
            w = list(t)
            for _ in range(min(12, s.slack[k])):
                w.insert(rnd.randrange(1, len(w)), "".join(rnd.choice("qxzvk") for _ in range(7)))
            found = s.scan(" ".join(["filler"] * 30 + w + ["filler"] * 30))
            assert [(f[0], f[1]) for f in found] == [(name, 1.0)], (name, found)


def test_scan_against_brute_force_over_all_windows():
    """Never more matched words than a longest common subsequence with any window allows; and where one window holds all
    words of a notice in a row, a finding covers it."""
    s, rnd = L.scanner(), random.Random(12)
    length = lambda a, b: len(L._common(a, b, 0, 0))
    pool = [w for _, t in s.templates if len(t) < 20 for w in t] + ["x", "y"]
    short = [k for k, (_, t) in enumerate(s.templates) if len(t) < 20]
    for _ in range(25):
        words = [rnd.choice(pool) for _ in range(30)]
        at = rnd.randrange(30)
        k = rnd.choice(short)
        words[at:at] = s.templates[k][1]
        found = s.scan(" ".join(words))
        assert any(f[3] < at + len(s.templates[k][1]) and f[4] > at for f in found)
        for name, coverage, matched, first, last in found:
            best = max(length(words[first:last], t) for n, t in s.templates if n == name and abs(matched / len(t) - coverage) < 1e-6)
            assert matched <= best
    assert L._shortest("a b x a b c".split(), "a b c".split(), 0, 0) == [(3, 0), (4, 1), (5, 2)]


# --- decontamination ----------------------------------------------------------------------------------------------
ITEM = "A farmer named Tom has 12 kg of apples and Tom sells 5 kg of apples to the old miller before noon"


def test_leaks(spark, nothing):
    pre, post = "some words come before the question here. ", " and other words follow it until the end"
    same = ITEM.replace("Tom", "Anna").replace("12", "20").replace("5 kg", "7 kg")
    rows = [(0, pre + ITEM + post), (1, pre + same + post), (2, pre + ITEM.replace("and Tom", "and Bob") + post), (3, pre + post), (4, ITEM.upper()), (5, None), (6, ""), (7, pre + " ".join(ITEM.split()[:8])), (8, pre + ITEM + post), (None, ITEM), (8, pre + ITEM + post), (9, "tiny item text of five"), (10, "say: tiny item text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "tiny item text of five"), (4, "no"), (5, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in C.leaks(docs, bench).collect()}
    assert got[0, 1][0] == got[0, 5][0] == got[8, 1][0] == got[None, 1][0] == "exact"
    assert got[1, 1][0] == "reparameterised"
    assert (2, 1) not in got and not [k for k in got if k[0] in (3, 5, 6, 7)]
    assert got[9, 3] == got[10, 3] == ("exact", 1.0)
    assert C.leaks(nothing.select("doc_id", "text"), bench).count() == 0 and C.leaks(docs, bench.limit(0)).count() == 0
    kept = sorted(str(r.doc_id) for r in C.without_leaks(docs, bench).collect())
    assert got[4, 1] == ("exact", 1.0) and kept == sorted(map(str, (2, 3, 5, 6, 7)))
    assert C.without_leaks(docs, bench).columns == docs.columns


def found_in(spark, item, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.kind, r.coverage) for r in C.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_leaks_with_inserted_words_and_deviating_values(spark):
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["end"]
    inserted = " ".join([*words[:9], "more", *words[9:18], "again", *words[18:]])
    far = " ".join(words[:9] + ["filler"] * 60 + words[9:18] + ["filler"] * 60 + words[18:])
    assert found_in(spark, " ".join(words), inserted, " ".join(words[:9]), far) == {0: ("exact", 1.0)}
    letters = [a + b for a in "bcdfghjklm" for b in "aeiouy"]
    long = " ".join(f"{x} is 5 and {x}o" for x in letters[:40])
    once = long.replace("bi is 5", "bi is 6")
    got = found_in(spark, long, once, long.replace(" 5 ", " 7 "))
    assert got[0][0] == "exact" and got[0][1] > 0.9 and got[1] == ("reparameterised", 1.0)
    numbers = "3 14 15 92 65 35 89 79 32 38 46 26"
    assert found_in(spark, numbers, f"so {numbers} it is", numbers.replace("3", "4")) == {0: ("exact", 1.0)}


def test_leaks_in_other_letter_case_white_space_and_names(spark):
    got = found_in(spark, ITEM, ITEM.upper(), ITEM.lower(), ITEM.replace(" ", "\n  "), ITEM.replace("kg", "KG").replace("12", "20"), ITEM.title())
    assert [got[i] for i in (0, 1, 2, 4)] == [("exact", 1.0)] * 4 and got[3] == ("reparameterised", 1.0)
    item = "There were many apples. Anna gives two of them to her old uncle. Anna keeps the rest until winter."
    assert found_in(spark, item, "x. " + item.replace("Anna", "Berta")) == {0: ("reparameterised", 1.0)}


def test_values_are_a_function_of_the_items(spark):
    item = "The boy had 12 red marbles in his bag and later won 15 blue marbles from his older sister at school"
    got = found_in(spark, item, item.replace("12", "20").replace("15", "20"), item.replace("12", "twenty").replace("15", "forty two"), item.replace("12", "twelve"))
    assert got[0] == got[1] == ("reparameterised", 1.0) and got[2] == ("exact", 1.0)
    weights = "Each box weighs 5 kg when full and the van can carry 300 kg so how many boxes fit in it"
    assert found_in(spark, weights, weights.replace("kg", "kilograms"), weights.replace("5 kg", "five pounds").replace("300 kg", "900 pounds")) == {0: ("exact", 1.0), 1: ("reparameterised", 1.0)}
    greek = "Όταν ο Γιώργος αγόρασε 5 μήλα, ο Νίκος είχε ήδη πουλήσει 12 αχλάδια στην παλιά αγορά του χωριού"
    assert found_in(spark, greek, greek.replace("Γιώργος", "Κώστας").replace("12", "30")) == {0: ("reparameterised", 1.0)}


def test_spelled_numbers():
    assert [C.spelled(t.split()) for t in ("twelve", "twenty five", "three hundred five", "two thousand", "one million two hundred thousand seven")] == [12, 25, 305, 2000, 1_200_007]
    codes, slots, guessed = C.template("Twenty-five kilograms of Rice cost about 300 DOLLARS in Rome")
    assert len(codes) == 10 and slots == {0: C.NUMBER + "25", 1: C.UNIT + "kg", 3: C.NAME + "rice", 6: C.NUMBER + "300", 7: C.UNIT + "dollar", 9: C.NAME + "rome"} and not guessed


STORIES = [
    "{a} buys {x} {u} of flour and gives {y} {u} of it to {b}. How much flour does {a} have left at the end of the day?",
    "A train leaves the station of {a} at {x} km per hour while another one leaves {b} at {y} km per hour. When do the two trains meet on the way?",
    "In the garden of {a} there are {x} rows with {y} trees in each row, and {b} plants one more row. How many trees grow there now?",
    "{a} reads {x} pages every day and {b} reads {y} pages every day of the same long book. Who finishes the book first and how many days earlier?",
    "The shop of {a} sold {x} {u} of sugar on Monday and {y} {u} on Friday, but {b} returned half of it. How much sugar was sold in the end?",
]


def test_recall_and_precision_on_generated_questions(spark):
    """Consistently re-parameterised items with up to two inserted words are found; items with other stories are not."""
    rnd = random.Random(8)
    names, units, spelled = "Anna Berta Carl Dora Emil Frida Georg Hanna".split(), ["kg", "pounds", "grams", "ounces"], {7: "seven", 12: "twelve", 25: "twenty five"}

    def fill(story):
        a, b = rnd.sample(names, 2)
        return story.format(a=a, b=b, x=rnd.randint(30, 99), y=rnd.choice([7, 12, 25]), u=rnd.choice(units))

    items = [(i, fill(s)) for i, s in enumerate(STORIES)]
    rows, want = [], set()
    filler = "the old harbour lay quiet under low clouds while boats came home with little fish and tired crews went up the hill to sleep".split()
    for k in range(200):
        i = k % len(STORIES)
        text = fill(STORIES[i])
        if k % 2:
            text = " ".join(spelled.get(int(w), w) if w.isdigit() else w for w in text.split())
        w = text.split()
        for _ in range(k % 3):  # inserted words
            w.insert(rnd.randrange(1, len(w)), rnd.choice(("really", "often", "also")))
        rows.append((k, " ".join(rnd.sample(filler, 15)) + ". " + " ".join(w) + " " + " ".join(rnd.sample(filler, 15))))
        want.add((k, i))
    rows += [(1000 + k, " ".join(rnd.choice(filler) for _ in range(40)) + f" {rnd.choice(names)} has {rnd.randint(1, 99)} {rnd.choice(units)} of flour left at the end of the day") for k in range(100)]
    got = {(r.doc_id, r.item_id) for r in C.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("recall", len(got & want) / len(want), "precision", len(got & want) / max(1, len(got)))
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_common_windows_give_the_same_leaks(spark, monkeypatch):
    """Items with shared boilerplate, as few and as many as make all windows common."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rule = " ".join(word() for _ in range(14))
    short_rule = " ".join(word() for _ in range(9))
    items = [(i, f"{rule} " + " ".join(word() for _ in range(20))) for i in range(6)] + [(10 + i, f"{short_rule} " + " ".join(word() for _ in range(30))) for i in range(6)]
    docs = [(0, rule), (1, short_rule), (2, items[0][1]), (3, items[7][1]), (4, items[1][1] + " " + short_rule), (5, " ".join(items[8][1].split()[9:])), (6, " ".join(items[9][1].split()[:26]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, r.coverage, r.matched_words) for r in C.leaks(d, b).collect())
    want = found()
    assert {(0, i) for i in range(6)} | {(3, 11), (5, 12), (6, 13)} <= {w[:2] for w in want} and not [w for w in want if w[0] == 1]
    for common in (0, 1, 3):
        monkeypatch.setattr(C, "COMMON", common)
        assert found() == want


def test_join_without_the_bit_table_finds_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a = sorted((r.doc_id, r.item_id, r.coverage) for r in C.leaks(docs, bench).collect())
    monkeypatch.setattr(C, "FILTERED", 0)
    assert a and a == sorted((r.doc_id, r.item_id, r.coverage) for r in C.leaks(docs, bench).collect())


def test_leaks_by_brute_force(spark):
    """Every document that holds a whole item as a run of words, and none that holds less than half of any."""
    import re

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for d, t in docs:
        line = " " + " ".join(words(t)) + " "
        want |= {(d, i) for i, x in items if len(words(x)) >= C.MIN_WORDS and " " + " ".join(words(x)) + " " in line}
    got = {(r.doc_id, r.item_id) for r in C.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want and want == got


# --- near duplicates ----------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    import xxhash

    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_by_brute_force(spark, docs, texts):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(3)
    rows += [(10_000 + i, t) for i, t in enumerate(texts[:120])]
    for i in range(150):  # chains of small changes
        w = rows[rnd.randrange(len(rows))][1]
        w = (w or "a b c d e f").split()
        if w:
            w[rnd.randrange(len(w))] = "changed"
        rows.append((20_000 + i, " ".join(w)))
    rows += [(None, rows[5][1]), rows[7]]
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = sorted((str(d), f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == want
    kept = sorted(str(r.doc_id) for r in N.keep_one(df).collect())
    assert kept == sorted({str(c) for c in least.values()}) and N.keep_one(df).columns == df.columns
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    rnd = random.Random(6)
    a, b, c, d = (" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, d), (None, d), (None, a)]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("5", b), ("None", c), ("None", d)])


def test_spread_join_is_a_join(spark, monkeypatch):
    """Keys far above, at and below a piece; rows that repeat."""
    from cadenza.llm import common

    monkeypatch.setattr(common, "PIECE", 3)
    monkeypatch.setattr(common, "PIECES", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("hot", 7)] * 5 + [("warm", i) for i in range(4)] + [("cold", 1), ("none", 2)], "k string, v long")
    n = rows.groupBy("k").agg(F.count("*").alias("n"))
    table = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("warm", "c"), ("cold", "d"), ("other", "e")], "k string, w string")
    want = sorted(tuple(r) for r in rows.join(table, "k").collect())
    for total in (0, 20, 61, 10_000):
        got = common.spread_join(rows, table.join(n, "k"), "k", total)
        assert got.columns == ["k", "v", "w"] and sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("pieces", [(2, 4), None])
def test_near_duplicates_with_hot_keys(spark, monkeypatch, pieces):
    """A third of all rows empty, another third exact copies, and a cloud of close texts."""
    if pieces:
        from cadenza.llm import common

        monkeypatch.setattr(common, "PIECE", pieces[0])
        monkeypatch.setattr(common, "PIECES", pieces[1])
    rnd = random.Random(13)
    base = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = [(i, "") for i in range(60)] + [(100 + i, " ".join(base[:50])) for i in range(60)]
    for i in range(40):
        w = list(base)
        w[rnd.randrange(300)] = "x"
        rows.append((200 + i, " ".join(w)))
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[c] for (i, _), c in zip(rows, comp)} and len(set(got.values())) < 40


@pytest.mark.parametrize("bucket", [4, 4000])
def test_links_keep_components(spark, monkeypatch, bucket):
    """Clouds of close fingerprints, also with buckets so small that they are cut into chunks."""
    monkeypatch.setattr(N, "BUCKET", bucket)
    rnd = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rnd.randint(0, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in N.components(N.links(df, len(fps))).collect()}
    comp = brute_components(fps)
    groups = {}
    for s, c in zip(signed, comp):
        groups.setdefault(c, set()).add(s)
    ours = {}
    for s in signed:
        ours.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_blocks_meet_every_close_pair():
    rnd = random.Random(5)
    for n in (10, 10**8, 10**10):
        m = N.masks(N.blocks_for(n))
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for i in rnd.sample(range(64), 4):
                b ^= 1 << i
            assert any(a & x == b & x for x in m)
    assert N.blocks_for(10) == 7 < N.blocks_for(10**9)


def test_forest_is_one_tree_a_component():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 63, 60, dtype=np.uint64)) for b in base]))
    a, b = N.forest(fps)
    comp = brute_components([int(x) for x in fps])
    assert len(a) == len(fps) - len(set(comp)) and (a < b).all()
