"""Recurring series from events, and their occurrences.

Events have idx, their place over all files, and the columns of parse_ics. A
series is a master event with the overrides of its UID. Occurrences are known
by their series, zone and wall time; all steps are joins and aggregates on
these, so that a UID shared by very many events needs no group in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from ..functions.time import TIME, duration_seconds, instant_text, parse_wall, time_key, zone_label
from ..session import stored
from .recurrence import capped, combine, expand_rules, expansion_codes, occurrence_end, rule_code, rule_text, unsupported_parts
from .search import numbered_within

#: Columns of an occurrence's record, in order: fixed by the tool.
RECORD = ["title", "occurrence_start", "occurrence_end", "timezone", "time_kind", "all_day", "location", "uid", "recurrence_id", "occurrence_source", "modified", "status", "source_file"]
KEYS = ("series_id", "tzid")


@dataclass(frozen=True)
class Series:
    """series: a row per master (series_id, idx, uid, dtstart, tzid, kind, rrule, description, supported, cutoff and counts);
    overrides: (series_id, idx, tzid, identity, new_start, cancelled), the usable ones; diagnostics: (code, idx, event_uid, detail)."""

    series: DataFrame
    overrides: DataFrame
    diagnostics: DataFrame


@dataclass(frozen=True)
class Expansion:
    """occurrences: series_id, start, tzid, idx, cancelled, mismatch, truncated and RECORD."""

    occurrences: DataFrame
    series: Series
    diagnostics: DataFrame


def wall(time: Column) -> Column:
    return parse_wall(time["raw"])


def zone(time: Column) -> Column:
    return F.when(time["kind"] == "zoned", F.coalesce(time["tzid"], F.lit(""))).otherwise("")


def _told(df: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), "idx", F.col("uid").alias("event_uid"), (F.lit("") if detail is None else detail).alias("detail"))


def recurrence_series(events: DataFrame) -> Series:
    """The series of events; an event without a UID is a group of its own."""
    uid = F.trim(F.coalesce("uid", F.lit("")))
    key = F.when(uid != "", uid).otherwise(F.concat(F.lit("missing-uid-"), F.col("idx")))
    is_override = F.col("recurrence_id").isNotNull()
    rows = events.select("idx", "uid", key.alias("group"), "start_time", "recurrence_id", F.coalesce("rrule", F.lit("")).alias("rrule"), "rdates", "exdates", F.upper(F.coalesce("status", F.lit(""))).alias("status"), (F.col("recurrence_range") if "recurrence_range" in events.columns else F.lit("")).alias("range"))
    rows = stored(rows.where(is_override | (F.col("rrule") != "") | (F.size("rdates") > 0) | (uid != "")))
    facts = rows.groupBy("group").agg(F.min("idx").alias("first_index"), F.count_if(is_override).alias("n_overrides"), F.count_if(~is_override & ((F.col("rrule") != "") | (F.size("rdates") > 0))).alias("own"), F.count_if(~is_override).alias("plain"))
    # with overrides every other event of the group is a master, else those that recur
    facts = stored(facts.withColumn("n_masters", F.when(F.col("n_overrides") > 0, F.col("plain")).otherwise(F.col("own"))).where("n_overrides > 0 or own > 0").select("group", "first_index", "n_overrides", "n_masters"))
    joined = rows.join(facts, "group")
    masters = joined.where(~is_override & ((F.col("rrule") != "") | (F.size("rdates") > 0) | (F.col("n_overrides") > 0)))
    masters = numbered_within(masters, "group", "idx", "place")
    unsupported = rule_code(F.col("rrule"))
    t = F.col("start_time")
    masters = masters.select(
        F.concat("group", F.lit("::"), F.col("first_index") + F.col("place")).alias("series_id"), "group", "place", "idx", "uid", wall(t).alias("dtstart"), zone(t).alias("tzid"), t["kind"].alias("kind"), "rrule",
        rule_text(F.col("rrule")).alias("description"), unsupported.alias("code"), "rdates", "exdates", "n_masters",
    )
    masters = stored(masters)
    first = masters.where("place = 0").select("group", "series_id", F.col("kind").alias("master_kind"))
    r = F.col("recurrence_id")
    placed = joined.where(is_override & (F.col("n_masters") > 0)).join(first, "group").select("series_id", "idx", "uid", "master_kind", "recurrence_id", "range", wall(F.col("start_time")).alias("new_start"), (F.col("status") == "CANCELLED").alias("cancelled"), time_key(r).alias("key"))
    placed = stored(placed)
    fits = placed.where(r["kind"] == F.col("master_kind"))
    firsts = fits.groupBy("series_id", "key").agg(F.min("idx").alias("first_idx"))
    known = fits.join(firsts, ["series_id", "key"])
    usable = known.where("idx = first_idx")
    cutoffs = usable.where(F.col("range") == "THISANDFUTURE").groupBy("series_id").agg(F.min_by(F.struct(wall(r).alias("cutoff"), F.col("idx").alias("cutoff_idx")), "idx").alias("c")).select("series_id", "c.*")
    cutoffs = stored(cutoffs)
    overrides = stored(usable.select("series_id", "idx", zone(r).alias("tzid"), wall(r).alias("identity"), "new_start", "cancelled", "range"))
    counts = overrides.groupBy("series_id").agg(F.count("*").alias("n_overrides"))
    series = masters.join(cutoffs.select("series_id", "cutoff"), "series_id", "left").join(counts, "series_id", "left")
    n = lambda c: F.size(c).cast("long")
    series = series.select(
        "series_id", "idx", "uid", "dtstart", "tzid", "kind", "rrule", F.when(F.col("code").isNull(), F.col("description")).otherwise("Complex recurrence rule").alias("description"), F.col("code").isNull().alias("supported"), "cutoff",
        n("rdates").alias("additions"), n("exdates").alias("exclusions"), F.coalesce("n_overrides", F.lit(0)).alias("overrides"), "rdates", "exdates",
    )
    parts = F.array_join(unsupported_parts(F.col("rrule")), ", ")
    told = [
        _told(joined.where(is_override & (F.col("n_masters") == 0)), "MISSING_RECURRENCE_MASTER"),
        _told(masters.where("n_masters > 1"), "DUPLICATE_RECURRENCE_MASTER"),
        _told(masters.where("code = 'UNSUPPORTED_RRULE_PART'"), "UNSUPPORTED_RRULE_PART", parts),
        _told(masters.where("code = 'INVALID_RRULE'"), "INVALID_RRULE", F.col("rrule")),
        _told(placed.where(r["kind"] != F.col("master_kind")), "RECURRENCE_TIME_KIND_MISMATCH", F.lit("RECURRENCE-ID")),
        _told(known.where("idx <> first_idx"), "DUPLICATE_RECURRENCE_OVERRIDE"),
        _told(placed.join(cutoffs.select("series_id", F.col("cutoff_idx").alias("idx")), ["series_id", "idx"], "left_semi"), "UNSUPPORTED_THISANDFUTURE"),
    ]
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    return Series(series, overrides, every)


def counters(series: DataFrame) -> DataFrame:
    """One row: series, those with exclusions, additions and overrides, and unsupported ones."""
    has = lambda c: F.count_if(F.col(c) > 0)
    return series.agg(F.count("*").alias("recurring_series"), has("exclusions").alias("series_with_exclusions"), has("additions").alias("series_with_additions"), has("overrides").alias("series_with_overrides"), F.count_if(~F.col("supported") | F.col("cutoff").isNotNull()).alias("unsupported_series"))


def expand_events(events: DataFrame, start: str, end: str, series_ids: DataFrame | None = None, limits: Limits = LIMITS) -> Expansion:
    """Occurrences of the events' series in a range of days; series_ids, rows (series_id), chooses among them."""
    found = recurrence_series(events)
    chosen = found.series if series_ids is None else found.series.join(series_ids.select("series_id").distinct(), "series_id", "left_semi")
    own = stored(chosen)
    rules = own.where("supported").select("series_id", "tzid", "dtstart", "rrule")
    generated = expand_rules(rules, start, end, limits.series_occurrences).join(own.select("series_id", "tzid"), "series_id")

    def dates(c: str) -> DataFrame:
        each = own.select("series_id", "idx", "uid", F.col("kind").alias("own_kind"), F.explode(c).alias("d"))
        return each.select("series_id", "idx", "uid", "own_kind", F.col("d.kind").alias("kind"), zone(F.col("d")).alias("tzid"), wall(F.col("d")).alias("start"))

    additions, exclusions = dates("rdates"), dates("exdates").where("kind = own_kind")
    masters = own.select("series_id", "tzid", F.col("dtstart").alias("start"))
    kept = combine(masters, generated.select(*KEYS, "start"), additions.where("kind = own_kind").select(*KEYS, "start"), exclusions.select(*KEYS, "start"), start, end, KEYS)
    kept = kept.join(own.select("series_id", "cutoff"), "series_id").where("cutoff is null or start < cutoff").drop("cutoff")
    changes = found.overrides.where(F.coalesce("range", F.lit("")) != "THISANDFUTURE").join(own.select("series_id"), "series_id", "left_semi")
    both = kept.withColumnRenamed("start", "identity").join(changes.select(*KEYS, "identity", F.col("idx").alias("changed_by"), "new_start", "cancelled"), [*KEYS, "identity"], "full_outer")
    changed = F.col("changed_by").isNotNull()
    inside = F.to_date("new_start").between(start, end)
    both = both.where(~changed | inside | (F.col("cancelled") & F.col("source").isNotNull()))
    both = both.join(own.select("series_id", F.col("idx").alias("master_idx")), "series_id")
    rows = both.select("series_id", "tzid", "identity", F.coalesce("new_start", "identity").alias("start"), F.coalesce("changed_by", "master_idx").alias("idx"), changed.alias("modified"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"), F.when(changed, "override").otherwise(F.col("source")).alias("source"), (changed & F.col("source").isNull()).alias("mismatch"))
    # expanded once: counts of series and the capped rows themselves both read it
    rows = stored(capped(stored(rows), limits.series_occurrences, limits.occurrences))
    codes = expansion_codes(rules, start, end, limits.series_occurrences).where("code = 'RECURRENCE_LIMIT_REACHED'").unionByName(rows.where("truncated").select("series_id", F.lit("RECURRENCE_LIMIT_REACHED").alias("code")).distinct())
    told = found.diagnostics.unionByName(_told(additions.where("kind <> own_kind"), "RECURRENCE_TIME_KIND_MISMATCH", F.lit("RDATE")))
    told = told.unionByName(_told(own.join(codes.select("series_id"), "series_id", "left_semi"), "RECURRENCE_LIMIT_REACHED"))
    told = told.unionByName(_told(rows.where("mismatch").select("idx").join(events.select("idx", "uid"), "idx"), "RECURRENCE_OVERRIDE_MISMATCH"))
    return Expansion(records(rows, events), found, told.distinct())


def shown(at: Column, kind: Column) -> Column:
    """A wall time as text: a date, an instant, or neither's local form."""
    t = at.cast("timestamp")
    return F.when(kind == "date", F.date_format(t, "yyyy-MM-dd")).when(kind == "utc", instant_text(t)).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))


def expand_event(events: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """Occurrences of events that must have no more than `limit` in all; raises ValueError if they have."""
    x = expand_events(events, start, end, limits=replace(LIMITS, series_occurrences=limit, occurrences=limit))
    if not x.diagnostics.where("code = 'RECURRENCE_LIMIT_REACHED'").isEmpty():
        raise ValueError(f"there are more than {limit} occurrences in this range")
    return x.occurrences.select("title", F.col("occurrence_start").alias("start"), F.col("occurrence_end").alias("end"), "timezone", "time_kind", "uid", "source_file")


def records(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Occurrences with RECORD: an override's own event, or the master's with times on the occurrence."""
    e = events.select("idx", "title", "location", "uid", "source_file", "start_time", "end_time", F.coalesce("duration", F.lit("")).alias("duration"), F.upper(F.coalesce("status", F.lit(""))).alias("event_status"))
    kind = F.col("start_time.kind")
    length = F.when(F.col("duration") != "", duration_seconds(F.col("duration")))
    end = occurrence_end(F.col("start"), wall(F.col("start_time")), wall(F.col("end_time")), length)
    end_kind = F.coalesce(F.col("end_time.kind"), kind)
    gone = F.col("cancelled") | (F.col("event_status") == "CANCELLED")
    status = F.when(gone, "Cancelled").when(F.col("modified"), "Modified occurrence").when(F.col("source") == "rdate", "RDATE").otherwise("Recurring")
    time = F.struct(kind.alias("kind"), F.lit("").alias("raw"), F.lit("").alias("value"), F.when(kind == "zoned", F.col("tzid")).alias("tzid"), F.lit(None).cast("timestamp").alias("instant")).cast(TIME)
    own_zone = F.when(F.col("modified"), zone_label(F.col("start_time"))).otherwise(zone_label(time))
    return rows.join(e, "idx").select(
        "series_id", "start", "tzid", "idx", "cancelled", "mismatch", "truncated", "title", shown(F.col("start"), kind).alias("occurrence_start"), F.coalesce(shown(end, end_kind), F.lit("")).alias("occurrence_end"), own_zone.alias("timezone"), kind.alias("time_kind"), (kind == "date").alias("all_day"),
        "location", "uid", shown(F.col("identity"), kind).alias("recurrence_id"), F.col("source").alias("occurrence_source"), "modified", status.alias("status"), "source_file",
    )


def occurrence_order() -> list[Column]:
    """Occurrences by start, then by series."""
    return [F.col("start"), F.col("series_id"), F.col("recurrence_id")]
