"""Calendar output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_ics, fold
from ..sources.ics import UNTITLED

HEAD = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//kalends//EN\r\nCALSCALE:GREGORIAN"
#: Raw properties that are written back as they were: fixed by the format's tool.
PRESERVED = ["ORGANIZER", "ATTENDEE", "URL", "GEO"]


def time_line(name: str, t: Column) -> Column:
    zone = F.when(t["kind"] == "date", ";VALUE=DATE").when(t["kind"] == "zoned", F.concat(F.lit(";TZID="), F.when(t["tzid"].rlike("[:;,]"), F.concat(F.lit('"'), t["tzid"], F.lit('"'))).otherwise(t["tzid"]))).otherwise("")
    return F.when(t.isNotNull(), F.concat(F.lit(name), zone, F.lit(":"), t["raw"]))


def event_lines(events: DataFrame, key: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(key columns and an event's unfolded lines, the columns of single lines before its lists, those of lists), in the fixed order of fields; a null is no line."""
    text = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), escape_ics(c)))
    plain = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), c))
    lists = lambda name, c: F.when(F.size(c) > 0, F.transform(c, lambda t: time_line(name, t)))
    kept = F.transform(F.filter("raw_properties", lambda p: p["name"].isin(PRESERVED) | p["name"].startswith("X-") | ((p["name"] == "RDATE") & p["raw"].rlike("(?i)VALUE=PERIOD"))), lambda p: p["raw"])
    categories = F.when(F.size("categories") > 0, F.concat(F.lit("CATEGORIES:"), F.array_join(F.transform("categories", escape_ics), ",")))
    head = [
        F.lit("BEGIN:VEVENT"), plain("UID", F.col("uid")), time_line("DTSTAMP", F.col("dtstamp")), time_line("DTSTART", F.col("start_time")), time_line("DTEND", F.col("end_time")),
        F.when(F.col("end_time").isNull(), plain("DURATION", F.col("duration"))), F.when(F.col("title") == UNTITLED, F.lit("SUMMARY:")).otherwise(F.concat(F.lit("SUMMARY:"), escape_ics(F.col("title")))), text("DESCRIPTION", F.col("description")), text("LOCATION", F.col("location")), plain("STATUS", F.col("status")), plain("RRULE", F.col("rrule")),
    ]
    tail = [time_line("RECURRENCE-ID", F.col("recurrence_id")), F.when(F.col("sequence").isNotNull(), F.concat(F.lit("SEQUENCE:"), F.col("sequence").cast("string"))), time_line("CREATED", F.col("created")), time_line("LAST-MODIFIED", F.col("last_modified")), categories]
    each = [("one", c) for c in head] + [("all", lists("RDATE", F.col("rdates"))), ("all", lists("EXDATE", F.col("exdates")))] + [("one", c) for c in tail] + [("all", kept), ("one", F.lit("END:VEVENT"))]
    names = [f"_{kind}{k}" for k, (kind, _) in enumerate(each)]
    return events.select(*key, *(c.alias(n) for n, (_, c) in zip(names, each))), [n for n in names if n.startswith("_one")], names


def event_text(events: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, text): an event's folded lines, joined by CRLF."""
    lines, single, names = event_lines(events, key)
    # lines are looked at one by one only if one of them must be folded
    longest = F.greatest(*map(F.octet_length, single), *(F.when(F.size(n) > 0, F.array_max(F.transform(n, F.octet_length))) for n in names if n not in single))
    folded = lambda n: fold(F.col(n)) if n in single else F.transform(n, fold)
    whole = F.array_join(F.flatten(F.array_compact(F.array(*(F.array_compact(F.array(folded(n)) if n in single else folded(n)) for n in names)))), "\r\n")
    return lines.select(*key, F.when(longest <= 75, F.concat_ws("\r\n", *names)).otherwise(whole).alias("text"))


def write_calendar(events: DataFrame, path: str, name: str = "", zones: list[str] | None = None) -> None:
    """One calendar as text parts in order: its head, the events by idx, its end."""
    spark = events.sparkSession
    top = [HEAD, *([f"X-WR-CALNAME:{name}"] if name else []), *(zones or [])]
    ends = spark.createDataFrame([(-1, "\r\n".join(top)), (2**62, "END:VCALENDAR")], "idx long, text string")
    texts = event_text(events, ["idx"]).select(F.col("idx").cast("long"), "text").unionByName(ends)
    texts.repartitionByRange("idx").sortWithinPartitions("idx").select("text").write.option("lineSep", "\r\n").text(path)
