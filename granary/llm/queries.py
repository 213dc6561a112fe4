"""Registered queries of the text operators and their check SQL.

Each query applies its operator to the whole table it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import (
    bpe, fingerprints, language, licenses, merkle, mixing, ngram_join, quality, secret_scan, substring_dedup, toxicity, warc, whitening,
)

Build = Callable[[SparkSession, str], DataFrame]


def _over(table: str, report: Callable[[DataFrame], DataFrame]) -> Build:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return report(spark.read.parquet(f"{folder}/{table}.parquet"))
    return build


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.report(docs, labels)


QUERIES: dict[str, Build] = {
    "op1_substring_dedup": _over("documents", substring_dedup.report),
    "op2_license_scan": _over("documents", licenses.report),
    "op3_source_mix": _over("documents", mixing.report),
    "op4_secret_scan": _over("documents", secret_scan.report),
    "op5_fingerprints": _over("documents", fingerprints.report),
    "op6_byte_bpe": _over("documents", bpe.report),
    "op7_toxicity": _toxicity,
    "op8_ngram_join": _over("documents", ngram_join.joined),
    "op9_warc": _over("pages", warc.report),
    "op10_quality_rules": _over("documents", quality.report),
    "op11_language_id": _over("documents", language.report),
    "op12_merkle_manifest": _over("documents", merkle.report),
    "op13_whitening": _over("embeddings", whitening.report),
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": mixing.copies_sql(),
    "op10_quality_rules": quality.report_sql(),
    "op12_merkle_manifest": merkle.report_sql(),
}
