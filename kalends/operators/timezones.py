"""Time zones of events: analysis, conversion and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import TIME, as_wall, is_supported_zone, parse_wall, wall_instant, wall_instants, zone_label


def analyze(events: DataFrame) -> DataFrame:
    """One row of counts: events by the kind of their start, values without a usable zone, and a histogram of zones."""
    every = F.filter(F.concat(F.array("start_time", "end_time", "recurrence_id"), F.col("rdates"), F.col("exdates")), lambda t: t.isNotNull())
    zoned = lambda t: t["kind"] == "zoned"
    status = lambda t: F.size(wall_instants(parse_wall(t["raw"]), F.when(is_supported_zone(t["tzid"]), t["tzid"]).otherwise("UTC")))
    size = lambda f: F.size(F.filter("times", f)).cast("long")
    counted = events.withColumn("times", every).select(
        F.col("start_time.kind").alias("kind"), zone_label(F.col("start_time")).alias("zone"),
        size(lambda t: zoned(t) & ~is_supported_zone(t["tzid"])).alias("unknown"),
        size(lambda t: zoned(t) & is_supported_zone(t["tzid"]) & (status(t) == 2)).alias("ambiguous"),
        size(lambda t: zoned(t) & is_supported_zone(t["tzid"]) & (status(t) == 0)).alias("nonexistent"),
    )
    totals = counted.agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("utc", "zoned", "floating", "date")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unknown", "ambiguous", "nonexistent")))
    zones = counted.groupBy("zone").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "count")))).alias("zones"))
    return totals.crossJoin(zones)  # one row each


def histogram(events: DataFrame) -> DataFrame:
    """(zone, events): how many events start in each zone."""
    return events.groupBy(zone_label(F.col("start_time")).alias("zone")).agg(F.count("*").alias("events"))


def basic(wall: Column) -> Column:
    return F.date_format(wall, "yyyyMMdd'T'HHmmss")


def converted(time: Column, target: str) -> Column:
    """The same instant in another zone; times without an instant as they are."""
    wall = as_wall(time["instant"], F.lit(target))
    raw = F.concat(basic(wall), F.lit("Z" if target == "UTC" else ""))
    new = F.struct(F.lit("utc" if target == "UTC" else "zoned").alias("kind"), raw.alias("raw"), F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss").alias("value"), F.lit(None if target == "UTC" else target).cast("string").alias("tzid"), time["instant"].alias("instant"))
    return F.when(time["instant"].isNull(), time).otherwise(new).cast(TIME)


def assigned(time: Column, target: str) -> Column:
    """A floating time in a zone, its wall time kept; others as they are."""
    wall = parse_wall(time["raw"])
    utc = target == "UTC"
    new = F.struct(F.lit("utc" if utc else "zoned").alias("kind"), F.concat(time["raw"], F.lit("Z" if utc else "")).alias("raw"), time["value"].alias("value"), F.lit(None if utc else target).cast("string").alias("tzid"), wall_instant(wall, F.lit(target)).alias("instant"))
    return F.when(time["kind"] == "floating", new).otherwise(time).cast(TIME)


def preview(events: DataFrame, operation: str, target: str = "", source: str = "", selected: Column | None = None) -> DataFrame:
    """events with `result` (unchanged, changed, blocked or warning), `code`, and new_start, new_end.

    operation is inspect, convert or assign. The first rule that fits decides.
    """
    if operation not in ("inspect", "convert", "assign"):
        raise ValueError("operation is inspect, convert or assign")
    start, end = F.col("start_time"), F.col("end_time")
    known = is_supported_zone(F.lit(target)) if target else F.lit(False)
    zone = target or "UTC"
    times = F.filter(F.concat(F.array(start, end, F.col("recurrence_id")), F.col("rdates"), F.col("exdates")), lambda t: t.isNotNull() & (t["kind"] == "floating"))
    count = lambda t: F.size(wall_instants(parse_wall(t["raw"]), F.when(known, F.lit(zone)).otherwise("UTC")))
    label = zone_label(start)
    rules = [
        (~(selected if selected is not None else F.lit(True)), "unchanged", ""),
        (F.lit(operation == "inspect"), "unchanged", ""),
        (start["kind"] == "date", "unchanged", ""),
        (~known, "blocked", "UNKNOWN_TIMEZONE"),
    ]
    if operation == "assign":
        rules += [
            (start["kind"] != "floating", "unchanged", ""),
            (F.exists(times, lambda t: count(t) == 2), "blocked", "AMBIGUOUS_LOCAL_TIME"),
            (F.exists(times, lambda t: count(t) == 0), "blocked", "NONEXISTENT_LOCAL_TIME"),
        ]
    else:
        rules += [
            (start["kind"] == "floating", "warning", "TIMEZONE_CONVERSION_UNSAFE"),
            (F.lit(source != "") & (label != source), "unchanged", ""),
            (start["instant"].isNull() & ~is_supported_zone(F.coalesce(start["tzid"], F.lit(""))), "blocked", "UNKNOWN_TIMEZONE"),
            (start["instant"].isNull(), "blocked", "TIMEZONE_CONVERSION_UNSAFE"),
            (F.coalesce("rrule", F.lit("")) != "", "blocked", "RECURRENCE_TIMEZONE_WARNING"),
            (end.isNotNull() & (end["kind"] != "date") & end["instant"].isNull(), "blocked", "TIMEZONE_CONVERSION_UNSAFE"),
        ]
    outcome = F.struct(F.lit("changed").alias("result"), F.lit("").alias("code"))
    for condition, result, code in reversed(rules):
        outcome = F.when(condition, F.struct(F.lit(result).alias("result"), F.lit(code).alias("code"))).otherwise(outcome)
    change = converted if operation == "convert" else assigned
    done = events.withColumn("_outcome", outcome)
    new = lambda t: F.when(F.col("_outcome.result") == "changed", change(t, zone)).otherwise(t)
    return done.withColumn("result", F.col("_outcome.result")).withColumn("code", F.col("_outcome.code")).withColumn("new_start", new(start)).withColumn("new_end", F.when(end.isNotNull(), new(end))).drop("_outcome")


#: What a change may apply to.
SCOPES = ["eligible", "matching", "floating", "selected"]


def preview_scope(events: DataFrame, scope: str, operation: str, target: str, source: str = "", chosen: DataFrame | None = None) -> DataFrame:
    """`preview` of the events in a scope: all (eligible), those in the zone `source` (matching), those without a zone
    (floating), or those whose idx is among the rows of `chosen` (selected); the others are unchanged."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}")
    if scope == "selected":
        marked = events.join(chosen.select("idx", F.lit(True).alias("_chosen")).distinct(), "idx", "left")
        return preview(marked, operation, target, selected=F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    return preview(events, operation, target, source if scope == "matching" else "", F.col("start_time.kind") == "floating" if scope == "floating" else None)


def result_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("changed", "blocked", "warning", "unchanged")))
