"""The operators' registered queries: thin calls over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .encoder import public


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import round_trip

    return round_trip(documents(spark, sf_dir), public("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), public("word_bpe_49k.json"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, rate

    rated = rate(documents(spark, sf_dir), columns=["doc_id"])
    return rated.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in [*BASE, "base_failed", "kept"]))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), public("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.crc32("text").alias("kept_crc32"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, listed

    found = find(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import write_token_files

    files, keys = write_token_files(documents(spark, sf_dir), public("byte_bpe_50k.json"))
    return files.read(keys).drop("occurrence")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import rate_documents

    return rate_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """Quality rules, hard negatives and filter orders: SQL has no tokenizers, MinHash, alignment, trees, packing, files or fields."""
    return {"op4_quality": sql.quality(), "op11_hard_negatives": sql.hard_negatives(), "op13_filter_audit": sql.filter_audit()}
