"""Admission and reading of calendar and contact files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from ..operators.search import ranked

FILES = "source_index int, source_file string, text string"


def admit(spark: SparkSession, path: str, extension: str, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(files with FILES columns, rejected with source_file and message): the extension, 1 byte to the size limit.

    Files are numbered by name; with a limit on files, those after it are
    rejected, too. Empty files don't appear: Spark doesn't list them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    message = F.when(~F.lower(name).endswith(extension), "The file type isn't supported.").when(F.col("length") > limits.file_bytes, "The file is too large.")
    seen = raw.select(name.alias("source_file"), "path", message.alias("message"), "content")
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "")
    names = ranked(seen.where("message is null").select("path", F.concat("source_file", F.lit("\n"), "path").alias("key")), "key")
    names = names.select("path", (F.col("rank") - 1).cast("int").alias("source_index"))
    files = seen.where("message is null").join(names, "path").select("source_index", "source_file", text.alias("text"))
    rejected = seen.where("message is not null").select("source_file", "message")
    if limits.files is None:
        return files, rejected
    over = files.where(F.col("source_index") >= limits.files).select("source_file", F.lit("There are too many files.").alias("message"))
    return files.where(F.col("source_index") < limits.files), rejected.unionByName(over)


def stream(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """New files of a folder as a stream of FILES rows without a number."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", f"*{extension}").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "")
    return raw.select(F.lit(0).alias("source_index"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), text.alias("text"), "modificationTime")
