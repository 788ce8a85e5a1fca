"""Calendar time on columns. The session's time zone must be UTC.

A calendar time is STRUCT<kind, raw, value, tzid, instant>: kind is utc, zoned,
floating or date; raw is the basic form (20260808T120000), value the extended
one; only utc and resolvable zoned times have an instant.
"""

from __future__ import annotations

import functools
import zlib
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

TIME = "struct<kind:string,raw:string,value:string,tzid:string,instant:timestamp>"
QUARTER, FARTHEST, REACH = 900, 50_400, 36
BUCKETS = 64


@functools.cache
def zones() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones() - {"localtime", "posixrules", "Factory"})


@functools.cache
def zone_buckets() -> str:
    """All zones' names between semicolons, those of one checksum modulo BUCKETS in one line."""
    lines = [";"] * BUCKETS
    for name in sorted(zones()):
        lines[zlib.crc32(name.encode()) % BUCKETS] += name + ";"
    return "\n".join(lines)


def is_supported_zone(tz: Column) -> Column:
    """Whether tz is a known zone: one literal of all names, as hundreds of them would swell every plan; only its line is searched."""
    name = F.coalesce(tz, F.lit(""))
    line = F.get(F.split(F.lit(zone_buckets()), "\n"), (F.crc32(name.cast("binary")) % BUCKETS).cast("int"))
    return (name != "") & ~name.contains(";") & line.contains(F.concat(F.lit(";"), name, F.lit(";")))


def as_wall(instant: Column, tz: Column) -> Column:
    """An instant's wall time in a zone, as TIMESTAMP_NTZ."""
    return F.from_utc_timestamp(instant, tz).cast("timestamp_ntz")


def wall_instants(wall: Column, tz: Column) -> Column:
    """The instants at which a zone's clocks show a wall time: none in a gap, two in a fold.

    The zone's offsets 36 hours before and after are the candidates; those that
    give the wall time back count. tz must be a supported zone.
    """
    n = wall.cast("timestamp")

    def offset(hours: int) -> Column:
        at = n + F.expr(f"interval '{hours}' hour")
        return F.unix_seconds(F.from_utc_timestamp(at, tz)) - F.unix_seconds(at)

    usable = F.filter(F.array_distinct(F.array(offset(-REACH), offset(REACH))), lambda o: (o % QUARTER == 0) & (F.abs(o) <= FARTHEST))
    candidates = F.transform(usable, lambda o: F.timestamp_seconds(F.unix_seconds(n) - o))
    return F.array_sort(F.filter(candidates, lambda c: F.from_utc_timestamp(c, tz) == n))


def wall_status(instants: Column) -> Column:
    return F.element_at(F.array(F.lit("nonexistent"), F.lit("valid"), F.lit("ambiguous")), F.size(instants) + 1)


def wall_instant(wall: Column, tz: Column) -> Column:
    """The one instant of a wall time; null in a gap, a fold or an unknown zone."""
    def found(x: Column) -> Column:
        only = let(wall_instants(x["wall"], x["tz"]), lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))))
        return F.when(x["tz"].isNotNull(), only)

    # bound, as Spark would read the wall time, look the zone up and search for the instants again at each mention
    return let(F.struct(wall.alias("wall"), F.when(is_supported_zone(tz), tz).alias("tz")), found)


def extended(raw: Column) -> Column:
    """20260808T120000 as 2026-08-08T12:00:00, 20260808 as 2026-08-08."""
    return F.when(F.length(raw) == 8, F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6"))


def parse_wall(raw: Column) -> Column:
    """TIMESTAMP_NTZ of a basic date-time or date; null if it isn't a real one. A 60th second is the next minute's first."""
    # the extended form is cast: a pattern that depends on the row makes Spark build a formatter for each
    at = lambda k, n: F.substring(raw, k, n)
    day = F.concat(at(1, 4), F.lit("-"), at(5, 2), F.lit("-"), at(7, 2))
    leap = F.concat(at(9, 1), at(14, 2)) == "T60"
    time = F.concat(day, F.lit("T"), at(10, 2), F.lit(":"), at(12, 2), F.lit(":"), F.when(leap, "59").otherwise(at(14, 2))).try_cast("timestamp_ntz")
    return F.when(raw.rlike(r"^\d{8}\z"), day.try_cast("timestamp_ntz")).when(raw.rlike(r"^\d{8}[Tt]\d{6}Z?\z"), F.when(leap, time + F.expr("interval '1' second")).otherwise(time))


def typed(raw: Column, tzid: Column, is_date: Column) -> Column:
    """A calendar time of a property's value and parameters; null if the value isn't a real time."""
    date = is_date | raw.rlike(r"^\d{8}$")
    wall = parse_wall(raw)
    ok = wall.isNotNull() & F.when(date, raw.rlike(r"^\d{8}$")).otherwise(raw.rlike(r"^\d{8}T\d{6}Z?$"))
    zone = F.coalesce(tzid, F.lit(""))
    kind = F.when(date, "date").when(raw.endswith("Z"), "utc").when(zone != "", "zoned").otherwise("floating")
    # clocks don't show a 60th second, so a zoned one has no instant
    instant = F.when(kind == "utc", wall.cast("timestamp")).when((kind == "zoned") & ~raw.rlike(r"T\d{4}60$"), wall_instant(wall, zone))
    return F.when(ok, F.struct(kind.alias("kind"), raw.alias("raw"), extended(raw).alias("value"), F.when(kind == "zoned", zone).alias("tzid"), instant.alias("instant")))


def zone_label(time: Column) -> Column:
    """What an event's zone is called in lists."""
    return F.when(time["kind"] == "date", "All-day").when(time["kind"] == "floating", "Floating").when(time["kind"] == "utc", "UTC").otherwise(F.coalesce(F.nullif(time["tzid"], F.lit("")), F.lit("Unknown")))


def time_key(time: Column) -> Column:
    """Equal for times of a series that mean the same: instants for utc, wall text and zone otherwise."""
    stamp = F.date_format(time["instant"], "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(time["kind"] == "utc", F.concat(F.lit("utc:"), F.coalesce(stamp, time["raw"]))).when(time["kind"] == "zoned", F.concat(F.lit("zoned:"), F.coalesce(time["tzid"], F.lit("")), F.lit(":"), time["raw"])).otherwise(F.concat(time["kind"], F.lit(":"), time["raw"]))


def identity_key(time: Column) -> Column:
    """Equal for times at one instant, or of one kind, zone and text where there is none."""
    stamp = F.date_format(time["instant"], "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(time["instant"].isNotNull(), stamp).otherwise(F.concat_ws(":", time["kind"], F.coalesce(time["tzid"], F.lit("")), time["raw"]))


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO duration such as P1DT2H; negative and unreadable ones are 0."""
    pattern = r"^([+-]?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("long"), F.lit(0).cast("long"))
    total = part(2) * 604_800 + part(3) * 86_400 + part(4) * 3_600 + part(5) * 60 + part(6)
    return F.when(F.coalesce(c, F.lit("")).rlike(pattern) & (F.regexp_extract(c, pattern, 1) != "-"), total).otherwise(F.lit(0).cast("long"))


def instant_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shown(time: Column, mode: str = "original", zone: str = "UTC") -> Column:
    """A time for CSV: original, utc, or local (in `zone`); times without an instant are never shifted."""
    if mode == "original":
        return F.when(time["kind"] == "utc", F.coalesce(instant_text(time["instant"]), time["value"])).otherwise(time["value"])
    if mode == "utc":
        return F.coalesce(instant_text(time["instant"]), time["value"])
    return F.coalesce(F.date_format(F.from_utc_timestamp(time["instant"], zone), "yyyy-MM-dd'T'HH:mm:ss"), time["value"])


def date_shown(instant: Column, mode: str = "iso", zone: str = "UTC") -> Column:
    """An instant as text: iso, or a medium date with the time of a zone, as in 7 Sept 2026, 09:05."""
    if mode == "iso":
        return instant_text(instant)
    return F.replace(F.date_format(F.from_utc_timestamp(instant, zone), "d MMM yyyy, HH:mm"), F.lit(" Sep "), F.lit(" Sept "))
