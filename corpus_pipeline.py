"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe_codec, decontamination, language_id, near_duplicates, quality
from cadenza.llm.common import materialize, scratch, table

#: Documents whose score is lower are rejected.
LEAST_QUALITY, LEAST_LANGUAGE = 0.5, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on the labels, scores below LEAST_QUALITY."""
    scored = quality.score(docs.select(F.struct("*").alias("row"), F.col("text").alias("_text")), quality.fit(docs, table(spark, sf_dir, "labels")), "_text")
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: without letters, or with a score below LEAST_LANGUAGE."""
    named = language_id.identify(docs.select(F.struct("*").alias("row"), F.col("text").alias("_text")), language_id.fit(docs), "_text")
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose fingerprints link (four bits at most); copies with
    more changes than that stay, as for the operator itself."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text again."""
    out = bpe_codec.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: No stage but a plain filter could be said in SQL; tests/llm compute all five in plain Python and compare the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What earlier stages wrote is deleted as soon as the next one is written; the last
    stage is computed when its rows are read, so its input stays in the shared folder."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            path, before = made.pop(), path
            made += [before] if before else []
    return STAGES[-1][1](spark, docs, sf_dir)
