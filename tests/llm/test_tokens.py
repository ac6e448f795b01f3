"""Token operators against the library on odd texts."""

import hashlib
import zlib

import numpy as np
import pytest

from cadenza.llm import bpe_codec, token_counts, token_files
from cadenza.llm.vocabulary import definition, library, merge, merge_ranks


def test_counts(docs, nothing, texts):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, limit=100).collect()}
    tk = library(token_counts.VOCABULARY)
    for i, t in enumerate(texts):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), repr(t)[:80]
    assert token_counts.count_tokens(docs).count() == docs.count()
    assert token_counts.count_tokens(nothing).count() == 0


def test_whole_tokens_are_proven():
    whole, tk = token_counts.prove_whole(), library(token_counts.VOCABULARY)
    assert len(whole) > 10_000
    for w in sorted(whole)[::500]:
        assert len(tk.model.tokenize(w)) == 1


def test_merging_long_and_short_agree():
    ranks = merge_ranks(definition(token_counts.VOCABULARY))
    from cadenza.llm.vocabulary import _merge_long

    for w in ["internationalization", "aaaaaaaaaaaaaaaa", "thethethethe", "qzxqzxq"]:
        assert merge(list(w), ranks) == _merge_long(list(w), ranks)


def test_bpe(docs, nothing, texts):
    out = bpe_codec.round_trip(docs)
    assert [c for c in out.columns if c.lower() == "ids"] == ["ids"]
    got = {r.doc_id: r for r in bpe_codec.digests(out).collect()}
    tk = library(bpe_codec.VOCABULARY)
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(t)[:80]
    assert bpe_codec.round_trip(nothing).count() == 0


def test_bpe_takes_separators_as_the_library_does():
    c, tk = bpe_codec.codec(bpe_codec.VOCABULARY), library(bpe_codec.VOCABULARY)
    for s in "\x1c\x1d\x1e\x1f":
        for t in (f"end.\n\n{s}Next", f"é.\n{s}\n Next{s}", f" {s} a", s, f"a{s}{s}b <|endoftext|>{s}\n\n"):
            assert np.frombuffer(c.encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "Hello  world<|endoftext|>"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded for r in bpe_codec.decode(bpe_codec.encode(df)).collect()}
    assert got == {1: "Hello  world<|endoftext|>", 2: ""}


def test_unique_last_token_by_brute_force():
    c = bpe_codec.codec(bpe_codec.VOCABULARY)
    tk = library(bpe_codec.VOCABULARY)
    for word in ["unbelievably", "aaaaaaa", "thethe", "xqzvw"]:
        for n in range(1, len(word) + 1):
            assert c.pretoken(word[:n]) == tk.encode(word[:n], add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files(spark, docs, nothing, texts, tmp_path, parts):
    path = token_files.write(docs.repartition(parts), f"file://{tmp_path}/ids")
    got = token_files.digests(token_files.read(spark, path)).collect()
    tk = library(token_files.VOCABULARY)
    rows = [(None, "no id"), *enumerate(texts), (20, texts[20])]
    at = 0
    for (doc_id, t), r in zip(sorted(rows, key=lambda x: -1 if x[0] is None else x[0]), sorted(got, key=lambda r: r.start)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(r.doc_id for r in token_files.read(spark, path, [3, 20]).collect()) == [3, 20, 20]
    empty = token_files.write(nothing, f"file://{tmp_path}/none")
    assert token_files.read(spark, empty).count() == 0


def test_columns_and_single_texts_agree(texts):
    """Chunks are cut by Arrow for a column and by Python for texts with separators; both give the library's ids."""
    import sys

    import pyarrow as pa
    import pyarrow.compute as pc

    e, tk = token_files.Encoder(token_files.VOCABULARY), library(token_files.VOCABULARY)
    odd = ["", " ", "Word, word. word! (word) 'quoted' it's it's. A.B. 3,4 x: y; Émile, Zürich. \u00a0a\u2003b\u0085c", "<|endoftext|>, a<|endoftext|>."]
    for some in ([t or "" for t in texts], [t for t in map(lambda t: t or "", texts) if not set(t) & set("\x1c\x1d\x1e\x1f")] + odd, odd[:1], odd[:2]):
        ids, stops = e.column(pa.array(some), 2)
        want = [tk.encode(t, add_special_tokens=False).ids + [2] for t in some]
        assert ids.tolist() == [i for w in want for i in w]
        assert stops.tolist() == np.cumsum([len(w) for w in want]).tolist()
    every = [f"a{chr(i)}b" for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not 0x1C <= i <= 0x1F]
    cut = pc.equal(pc.list_value_length(pc.utf8_split_whitespace(pa.array(every))), 2).to_pylist()
    assert all(t[1].isspace() for t, c in zip(every, cut) if c)


def test_pieces_hold_all_rows_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "PIECE", 10)
    texts = ["", "abc", "d" * 35, "", "é" * 4, "e", "f" * 10]
    whole = pa.RecordBatch.from_pydict({"text": texts})
    got = [p.column("text").to_pylist() for p in token_files.pieces(iter([whole.slice(0, 0), whole, whole.slice(1, 1)]))]
    assert [t for p in got for t in p] == [*texts, "abc"] and all(got)
    assert all(sum(len(t.encode()) for t in p[1:]) <= 10 for p in got)


def test_token_files_have_bloom_filters_and_stripes(spark, tmp_path):
    import pyarrow.orc as orc

    df = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 50) as text")
    path = token_files.write(df, f"file://{tmp_path}/ids", row_stride=1000)
    files = list((tmp_path / "ids").glob("*.orc"))
    assert files and sum(orc.ORCFile(f).nrows for f in files) == 3000
    plan = token_files.read(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters", 1)[1][:200]


def test_memo_is_bounded_in_bytes():
    """Texts without blanks, whose chunks are whole texts, are not held; others are, up to the bound."""
    from cadenza.llm import vocabulary as V

    memo = V.Memo(lambda k: k.encode() * 4, 1_000)
    for i in range(20_000):
        k = f"{i:05d}" + "漢" * (i % 150)
        assert memo[k] == k.encode() * 4
        assert len(memo) <= 1_000 and max(map(len, memo)) <= V.LONGEST
    assert sum(map(len, memo)) == memo.held <= 1_000 * V.MEMO_CHARS
    made = []
    kept = V.Memo(lambda k: made.append(k) or len(k), 100)
    for i in range(5_000):
        assert kept[f"rare{i}"] == len(f"rare{i}") and kept["frequent"] == 8
        assert len(kept) <= 50 and len(kept.older) <= 50
    assert made.count("frequent") == 1
    small = V.Memo(lambda k: 1, 10)
    assert [small[str(i % 5)] for i in range(50)] == [1] * 50 and len(small) == 5
