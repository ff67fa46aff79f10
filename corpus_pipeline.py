"""Staged clean-up of ``documents``: each stage is written as Parquet and read back by the next.

Every stage works on all rows its predecessor kept and calls one operator of
``benchlens.llm``. All but the last return the columns of ``documents``. Null
and empty texts, repeated rows and empty tables pass through each stage as its
operator defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.llm import language, packing, quality, secret_scan, simhash
from benchlens.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

QUALITY_AT = 0.3  # documents with a lower probability of label 1 go
LANGUAGE_AT = 0.3  # documents whose language is less certain go


def _judged(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside their text, so that no column of theirs meets a new one."""
    return docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("judged"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from ``labels``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.predict(_judged(docs), model, ["doc"], "judged").where(F.col("score") >= QUALITY_AT).select("doc.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: no letter, or no learnt language that fits, rejects a document."""
    model = language.fit(docs, F.lit(True))
    if model is None:  # nothing to learn from: no ground to reject on
        return docs
    kept = language.predict(_judged(docs), model, ["doc"], "judged")
    return kept.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_AT)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least doc_id."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text where it has changed."""
    forest = secret_scan.train(secret_scan.own_labels(secret_scan.candidates(docs, "text", "source")))
    changed = secret_scan.redact(docs.withColumn("_before", F.col("text")), forest, "text", "source")
    n = F.when(F.col("text") != F.col("_before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n).drop("_before")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document as pieces in sequences of at most 2048 tokens (see ``packing``)."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("subword_quality", keep_quality),
    ("hierarchical_language", keep_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Learnt models, fingerprints and packing have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
