"""Corpus pipeline: quality rules, near copies, secrets, source mix, token ids.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as
Parquet and reread as the next stage's documents. All but the last return the columns of
``documents``; null, empty and repeated rows follow the definitions of each stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, mixing, ngram_join, quality, secret_scan
from granary.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that break no quality rule."""
    return quality.accepted(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies one row, that of the smallest id."""
    return ngram_join.one_per_group(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row, with each secret in its text replaced by the name of its kind."""
    out = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The ids of every row's text, once for each time the mix took it."""
    out = bpe.encoded(docs, ["doc_id", "source"])
    return out.select("doc_id", "source", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_copy),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: Token ids and decoded secrets are beyond SQL; tests hold every stage and the chain against versions of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
