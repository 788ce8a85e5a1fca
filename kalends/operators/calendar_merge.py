"""Merging calendars: metadata by consensus, shared vendor lines, zone definitions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, trim
from ..functions.time import identity_key
from ..session import stored
from ..sources.ics import numbered, parse_ics
from .event_duplicates import candidates as duplicate_candidates

#: Methods that make a calendar an invitation, which a merge must not be: fixed values.
INVITATIONS = ["REQUEST", "REPLY", "CANCEL", "COUNTER", "ADD", "REFRESH", "DECLINECOUNTER"]
CONSENSUS = ["name", "description", "timezone", "refresh_interval", "color", "source"]


def agreed(c: str) -> Column:
    """The one non-empty value of all rows, or empty."""
    value = F.nullif(F.col(c), F.lit(""))
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise("")


def merged_metadata(metadata: DataFrame) -> DataFrame:
    """One row: fields all calendars agree on, and `warnings` naming those they don't."""
    odd = lambda c: F.min(F.nullif(F.col(c), F.lit(""))) < F.max(F.nullif(F.col(c), F.lit("")))
    method = F.when(F.upper(agreed("method")).isin(INVITATIONS), "").otherwise(agreed("method"))
    warned = F.array_compact(F.array(*(F.when(odd(c), F.lit(c)) for c in CONSENSUS), F.when(F.bool_or((F.col("calscale") != "") & (F.upper("calscale") != "GREGORIAN")), F.lit("calscale")), F.when(odd("method") | F.upper(agreed("method")).isin(INVITATIONS), F.lit("method"))))
    fields = [F.when(agreed("name") == "", "Merged calendar").otherwise(agreed("name")).alias("name"), *(agreed(c).alias(c) for c in CONSENSUS[1:])]
    return metadata.agg(F.lit("2.0").alias("version"), F.lit("GREGORIAN").alias("calscale"), method.alias("method"), *fields, warned.alias("warnings"))


def shared_vendor_lines(metadata: DataFrame) -> DataFrame:
    """(position, line): vendor lines of the first calendar that all calendars have."""
    total = metadata.agg(F.count_distinct("source_index").alias("total"))
    lines = metadata.select("source_index", F.posexplode("vendor_properties").alias("position", "line"))
    first = lines.groupBy("line").agg(F.count_distinct("source_index").alias("n"), F.min(F.struct("source_index", "position")).alias("at"))
    return first.crossJoin(total).where("n = total").select("at.position", "line")  # `total` is one row


def zone_definitions(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first definition of each zone id, ids whose definitions differ); white space doesn't count."""
    rows = metadata.select("source_index", F.posexplode("vtimezones").alias("position", "definition"))
    rows = rows.withColumn("tzid", F.lower(trim(F.regexp_extract("definition", r"(?m)^TZID[^:\n]*:(.*)$", 1)))).withColumn("canonical", trim(collapse(F.col("definition"))))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("tzid").orderBy("source_index", "position"))).where("n = 1")
    differing = rows.groupBy("tzid").agg(F.count_distinct("canonical").alias("definitions")).where("definitions > 1").select("tzid")
    return first.select("tzid", "definition", "source_index"), differing


def summary(events: DataFrame, candidates: DataFrame, definitions: DataFrame, diagnostics: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row of counts: sources, events, candidates, included, definitions, malformed."""
    broken = F.count_if((F.col("severity") == "error") & F.col("code").isin("MALFORMED_EVENT", "TRUNCATED_COMPONENT", "INVALID_DATE"))
    rows = events.agg(F.count_distinct("source_index").alias("sources"), F.count("*").alias("events"))
    kept = included(events, excluded).agg(F.count("*").alias("included"))
    for one in (candidates.agg(F.count("*").alias("candidates")), kept, definitions.agg(F.count("*").alias("definitions")), diagnostics.agg(broken.alias("malformed"))):
        rows = rows.crossJoin(one)  # one row each
    return rows


def included(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """events without those whose idx is excluded."""
    return events.join(excluded.select("idx").distinct(), "idx", "left_anti")


@dataclass(frozen=True)
class Merge:
    """What a merge of calendars would be: events with idx, candidates (idx, owner, confidence), one row of metadata, the zone
    definitions, diagnostics (severity, code, detail, source_file, event_uid) and one row of counts."""

    events: DataFrame
    candidates: DataFrame
    metadata: DataFrame
    definitions: DataFrame
    diagnostics: DataFrame
    summary: DataFrame


def analyze(files: DataFrame, excluded: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> Merge:
    """The merge of FILES rows' calendars; nothing is left out but the events of `excluded`, rows (idx), or a function of the numbered events that gives such.

    Events are parsed once and kept, with a row number. Their places are numbered beside them and joined by it,
    so what is asked of an event's own columns is worked out before a shuffle, and the columns stay.
    """
    parsed = parse_ics(files, keep=lambda df: stored(df.withColumn("row", F.monotonically_increasing_id())))
    places = stored(numbered(parsed.events.select("row", "source_index", "event_index")).select("row", "source_index", "idx"))
    place = places.select("row", "idx")
    events = parsed.events.join(place, "row").drop("row")
    metadata = stored(parsed.metadata)
    end = F.coalesce(identity_key(F.col("end_time")), F.col("duration"))
    keyed = parsed.events.select("row", "uid", identity_key(F.col("recurrence_id")).alias("identity"), "title", identity_key(F.col("start_time")).alias("start_key"), end.alias("end_key"), "location")
    found = stored(duplicate_candidates(keyed.join(place, "row").drop("row")))
    definitions, differing = zone_definitions(metadata)
    merged = merged_metadata(metadata)
    none = F.lit("")
    told = lambda df, code, detail, file=none, uid=none: df.select(F.lit("warning").alias("severity"), code.alias("code"), detail.alias("detail"), file.alias("source_file"), uid.alias("event_uid"))
    pairs = found.join(events.select("idx", "uid", "source_file"), "idx")
    own = parsed.unplaced.select("severity", "code", F.col("message").alias("detail"), "source_file", F.coalesce("event_uid", none).alias("event_uid"))
    every = own.unionByName(told(pairs, F.when(F.col("confidence") == "certain", "DUPLICATE_UID").otherwise("DUPLICATE_CANDIDATE"), F.col("confidence"), F.col("source_file"), F.col("uid")))
    every = every.unionByName(told(differing, F.lit("CONFLICTING_VTIMEZONE"), F.col("tzid")))
    every = every.unionByName(told(merged.select(F.explode("warnings").alias("field")), F.lit("MIXED_CALENDAR_METADATA"), F.col("field")))
    left = excluded(events) if callable(excluded) else excluded if excluded is not None else events.select("idx").limit(0)
    return Merge(events, found, merged, definitions, every, summary(places, found, definitions, own, left))
