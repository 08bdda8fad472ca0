"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit_packing, chunk_dedup, html_tagpath, language_hd, repetition, sentencepiece_codec, simhash_dedup, suffix_dedup, token_counts, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_documents(spark, sf_dir))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(_documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_pieces(_documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_copies(_documents(spark, sf_dir))


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(_documents(spark, sf_dir), length=token_counts.tokens(F.col("text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_hd.identify(docs, language_hd.train(docs))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tagpath.extract_content(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op2_simhash_dedup,
        op3_repetition,
        op4_sentencepiece,
        op5_suffix_dedup,
        op6_exact_dedup,
        op7_bestfit_packing,
        op8_token_counts,
        op9_language_id,
        op10_html_extraction,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": url_reputation.SQL,
    "op3_repetition": repetition.SQL,
    "op6_exact_dedup": chunk_dedup.SQL,
}
