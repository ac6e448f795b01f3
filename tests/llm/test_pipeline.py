"""The pipeline's stages on a small corpus."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cadenza.llm import language_id, quality, queries
from cadenza.llm.vocabulary import library
from tests.llm.test_documents import brute_components, brute_fingerprint

D = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "bpe"]


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = P.run(spark, D).collect()
    assert 0.5 * docs.count() < len(out) < docs.count() and all(r.lossless for r in out)
    text = {r.doc_id: r.text for r in docs.collect()}
    tk = library("byte_bpe_50k.json")
    assert all(r.n_tokens == len(tk.encode(text[r.doc_id], add_special_tokens=False).ids) for r in out)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 for r in out) <= 3
    assert len({r.doc_id for r in out}) == len(out)


def test_stages_against_plain_python(spark):
    """All five stages once more over Python lists: the networks asked text by text, fingerprints compared with each
    other, items looked for as runs of words, the library's ids."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    net = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rows = [(i, t) for i, t in rows if net.scores([t.encode()])[0] >= P.LEAST_QUALITY]
    left = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    net = language_id.fit(left)
    named = [language_id.classify([t], net) for _, t in rows]
    rows = [r for r, ((name,), (score,)) in zip(rows, named) if name != "und" and score >= P.LEAST_LANGUAGE]
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    rows = [(i, t) for (i, t), c in zip(rows, comp) if least[c] == i]
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in words(t) for x in items)]
    tk = library("byte_bpe_50k.json")
    want = sorted((i, tk.encode(t, add_special_tokens=False).ids) for i, t in rows)
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in P.run(spark, D).collect())
    assert len(want) > 50 and got == want


def test_intermediates_are_deleted(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = P.run(spark, D)
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and next(iter(new)).startswith("stage-decontamination") and out.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows(spark, docs, nothing, name):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    stage = dict(P.STAGES)[name]
    odd = docs.withColumn("lang", F.lit(None).cast("string"))
    extra = odd.unionByName(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", F.lit("c").alias("IDS"), F.lit(0.1).alias("score"), F.lit("l").alias("license"), "lang").withColumn("doc_id", F.col("doc_id") + 100_000))
    for df in (extra, nothing.withColumn("lang", F.lit("en"))):
        out = stage(spark, df, D)
        if name != "bpe":
            assert out.columns == df.columns
        n, m = out.count(), df.count()
        assert n <= m and (m == 0 or n > 0)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
