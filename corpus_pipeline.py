"""The corpus pipeline: quality rules, line dedup, near-dedup, redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalends.llm.common import private, temporary
from kalends.llm.encoder import public
from kalends.llm.line_dedup import dedup_lines
from kalends.llm.near_dup import keep_one
from kalends.llm.packing import pack
from kalends.llm.pii import redact
from kalends.llm.quality import rate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that pass the quality rules."""
    (out,) = private(docs, "quality")
    return rate(docs, out=out).where(F.col(f"{out}.kept")).drop(out)


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is one, of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated lines taken out of their texts; n_chars follows."""
    n_lines, n_removed = private(docs, "n_lines", "n_removed")
    return recounted(dedup_lines(docs, counts=(n_lines, n_removed)).drop(n_lines, n_removed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the least id."""
    return keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind; n_chars follows."""
    return recounted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 4096 tokens."""
    return pack(docs, public("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("pii", redaction), ("packing", packing)]

#: SQL can't express MinHash, alignment, boosted trees or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = temporary(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
