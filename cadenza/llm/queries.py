"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe_codec, decontamination, language_id, license_scan, media_archive, near_duplicates, quality, token_counts, token_files, url_filter
from cadenza.llm.common import Query, held_out, shared_dir, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = media_archive.write(table(spark, sf_dir, "documents"))
    return media_archive.digests(media_archive.with_features(media_archive.read(spark, path)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"))
    return token_files.digests(token_files.read(spark, path))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs)
    return language_id.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_license_scan, op2_media_columns, op3_token_counts, op4_quality, op5_token_files, op6_url_filter, op7_decontamination, op8_bpe, op9_language, op10_near_duplicates, pipeline)
}


def oracles() -> dict[str, str]:
    """SQL for what SQL can express; the rest is tested against the libraries and brute force in tests/llm."""
    return {"op6_url_filter": url_filter.oracle()}
