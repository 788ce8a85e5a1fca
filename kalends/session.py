"""Folders shared by the driver and all executors, and cutting lineage there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a temporary
    folder is set once if the session is local (tests, one machine); on a
    cluster that raises ValueError, for executors wouldn't see such a folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return where or current.get()
    if not where:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kalends-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def temporary(spark: SparkSession) -> str:
    """A new folder's name below the shared folder; it is deleted when the driver ends."""
    where = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    path, files = _path(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def stored(df: DataFrame) -> DataFrame:
    """df computed once and read again from a Parquet table in the shared folder.

    Columns are pruned when it is read, and small parts share a task. The table
    goes when the driver ends, or by `discard` before.
    """
    spark = df.sparkSession
    where = temporary(spark)
    df.write.mode("overwrite").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._stored_at = where
    return out


@contextlib.contextmanager
def spread(spark: SparkSession, rows: int, each: int = 1_000_000) -> Iterator[None]:
    """Shuffles of the tables computed inside have a partition for about `each` rows, and no fewer than the session's; small ones join again at run time."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(max(int(own), -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def discard(df: DataFrame) -> None:
    """Deletes what `stored` returned; nothing may read it any more."""
    path, files = _path(df.sparkSession, df._stored_at)
    files.delete(path, True)
