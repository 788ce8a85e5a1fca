"""Calendars and contacts that arrive as files, as streams.

The tools are batch tools; this is an addition. Parsing is the batch parsers'
column expressions, so only deduplication holds state, bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stream
from ..sources.ics import event_blocks, time_named
from ..sources.properties import first_value, parse_lines
from ..functions.text import unescape_text, unfold


def stream_events(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """(source_file, uid, title, start_time) of new files' events; an event that comes again within the delay counts once."""
    files = stream(spark, path, ".ics")
    blocks = files.select("source_file", "modificationTime", F.explode(event_blocks(F.concat(F.lit("\n"), unfold(F.col("text"))))).alias("block"))
    p = parse_lines(F.col("block"))
    rows = blocks.select("source_file", "modificationTime", first_value(p, "UID").alias("uid"), unescape_text(first_value(p, "SUMMARY")).alias("title"), time_named(p, "DTSTART").alias("start_time"), time_named(p, "RECURRENCE-ID").alias("recurrence_id"))
    keyed = rows.withColumn("instance", F.coalesce("recurrence_id.raw", F.lit("master"))).withWatermark("modificationTime", delay)
    return keyed.dropDuplicatesWithinWatermark(["uid", "instance"]).select("source_file", "uid", "title", "start_time")
