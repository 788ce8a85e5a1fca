"""Calendars: files to events, metadata and diagnostics.

Everything is a column expression: lines are unfolded, event blocks extracted
and their lines parsed in place, so a file is one row until its events are
exploded. A broken event costs itself alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from ..functions.bind import let
from ..functions.text import plain_ends, unescape_text, unfold
from ..functions.time import TIME, typed, zone_label
from ..operators.search import numbered_within, ranked, running_total
from ..session import stored
from .properties import first, first_value, named, parameter, parse_lines

UNTITLED = "(Untitled event)"
BEGIN, END = "\nBEGIN:VEVENT\n", "\nEND:VEVENT"
NESTED = r"(?s)BEGIN:(VALARM|VTODO|VJOURNAL)\n.*?END:\1\n?"
METADATA = {"prodid": ["PRODID"], "version": ["VERSION"], "method": ["METHOD"], "calscale": ["CALSCALE"], "name": ["NAME", "X-WR-CALNAME"], "description": ["DESCRIPTION", "X-WR-CALDESC"], "timezone": ["X-WR-TIMEZONE", "TIMEZONE-ID"], "refresh_interval": ["REFRESH-INTERVAL", "X-PUBLISHED-TTL"], "color": ["COLOR", "X-APPLE-CALENDAR-COLOR"], "source": ["SOURCE"]}
#: Properties that an event has one value or time of, and those it has once at most; fixed values.
VALUES = ["UID", "SUMMARY", "DESCRIPTION", "LOCATION", "DURATION", "STATUS", "RRULE", "SEQUENCE", "URL", "GEO"]
TIMES = ["DTSTART", "DTEND", "RECURRENCE-ID", "CREATED", "LAST-MODIFIED", "DTSTAMP"]
SINGLE = ["UID", "DTSTART", "DTEND", "SUMMARY", "DESCRIPTION", "LOCATION", "STATUS", "RRULE", "SEQUENCE", "ORGANIZER", "RECURRENCE-ID"]


@dataclass(frozen=True)
class Calendars:
    """`unplaced` are the diagnostics without their lines, which cost another pass over the texts."""

    events: DataFrame
    metadata: DataFrame
    diagnostics: DataFrame
    unplaced: DataFrame


def event_blocks(body: Column) -> Column:
    """The lines of each event of an unfolded text that starts with a line end. An event that doesn't end before the next begins has none."""
    parts = let(F.split(body, BEGIN), lambda x: F.slice(x, 2, F.size(x)))
    ended = F.filter(F.transform(parts, lambda b: F.concat(F.lit("\n"), b)), lambda b: b.contains(END))
    return F.transform(ended, lambda b: F.concat(F.substring(F.substring_index(b, END, 1), 2, 2**31 - 1), F.lit("\n")))


def time_of(p: Column) -> Column:
    told = F.struct(F.trim(p["value"]).alias("raw"), parameter(p, "TZID").alias("tzid"), (F.upper(parameter(p, "VALUE")) == "DATE").alias("date"))
    return let(told, lambda x: typed(x["raw"], x["tzid"], x["date"]))


def times_of(properties: Column, name: str) -> Column:
    """All values of a list property; periods have none, unreadable values are left out."""
    found = named(properties, name)
    each = F.transform(F.filter(found, lambda p: F.upper(parameter(p, "VALUE")) != "PERIOD"), lambda p: F.transform(F.split(p["value"], ","), lambda v: typed(F.trim(v), parameter(p, "TZID"), F.upper(parameter(p, "VALUE")) == "DATE")))
    return F.when(F.size(found) > 0, F.filter(F.flatten(each), lambda t: t.isNotNull())).otherwise(F.array().cast(f"array<{TIME}>"))


def time_named(properties: Column, name: str) -> Column:
    return let(first(properties, name), lambda p: F.when(p.isNotNull(), time_of(p)))


def person(p: Column) -> Column:
    """Name <address> if there is a CN, the bare address otherwise."""
    address = F.regexp_replace(p["value"], "(?i)^mailto:", "")
    name = parameter(p, "CN")
    return F.when(name != "", F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(address)


def issue(severity: str, code: str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def parse_ics(files: DataFrame, limits: Limits = LIMITS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Calendars:
    """Calendars of FILES rows. Text without BEGIN:VCALENDAR, empty and null text give an error row and no events.

    An event's diagnostics have the line, from 1, at which it begins in its file.
    With `stored` as `keep`, events are parsed once for all that is read of them.
    """
    whole = files.select("source_index", "source_file", F.concat(F.lit("\n"), unfold(F.coalesce("text", F.lit("")))).alias("body"))
    is_calendar = F.col("body").contains("\nBEGIN:VCALENDAR")
    begins, ends = F.regexp_count("body", F.lit(r"\nBEGIN:VEVENT(?=\n|$)")), F.regexp_count("body", F.lit(r"\nEND:VEVENT(?=\n|$)"))
    blocks = whole.where(is_calendar).select("source_index", "source_file", F.posexplode(F.slice(event_blocks(F.col("body")), 1, limits.events)).alias("event_index", "block"))
    # a file's events spread over the cluster, parsing being the costly part; one file may hold most of them
    # a number is given, as blocks are few bytes and Spark would join them to hardly more tasks than cores
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    events, per_event = parse_blocks(blocks.repartition(tasks, "source_index", "event_index"), limits, keep)
    file_issues = F.array_compact(F.array(
        F.when(~is_calendar, issue("error", "MALFORMED_EVENT", "The file isn't a calendar.")),
        F.when(is_calendar & ~F.col("body").rlike(r"\nEND:VCALENDAR\s*$"), issue("warning", "TRUNCATED_COMPONENT", "The calendar doesn't end.")),
        F.when(is_calendar & (begins > ends), issue("error", "TRUNCATED_COMPONENT", "An event doesn't end.")),
        F.when(is_calendar & (begins > limits.events), issue("error", "LIMIT_EXCEEDED", "The file has too many events.")),
    ))
    per_file = whole.select("source_index", "source_file", F.lit(None).cast("int").alias("event_index"), F.lit("").alias("event_uid"), F.explode(file_issues).alias("i"))
    fields = ["source_index", "source_file", "event_index", "event_uid", "i.severity", "i.code", "i.message"]
    placed = per_event.join(event_lines(files), ["source_index", "event_index"], "left")
    diagnostics = placed.unionByName(per_file, allowMissingColumns=True).select(*fields, "line")
    return Calendars(events, metadata(whole.where(is_calendar)), diagnostics, per_event.unionByName(per_file).select(*fields))


def event_lines(files: DataFrame) -> DataFrame:
    """(source_index, event_index, line): where the events of FILES rows begin. A file whose markers are folded or cased otherwise has none."""
    text = F.coalesce("text", F.lit(""))
    blocks = event_blocks(F.concat(F.lit("\n"), unfold(text)))
    known = let(block_lines(text), lambda x: F.when(F.size(x) == F.size(blocks), x))
    return files.select("source_index", F.posexplode(known).alias("event_index", "line"))


def parse_components(rows: DataFrame, limits: Limits = LIMITS) -> Calendars:
    """Calendars of COMPONENTS rows (see `splits`) of VEVENT; files and events are numbered by name and place.

    Metadata come from the lines outside events, which a file has few of.
    """
    rows = stored(rows)
    names = ranked(rows.select("source_file").distinct(), "source_file").select("source_file", (F.col("rank") - 1).cast("int").alias("source_index"))
    placed = rows.join(names, "source_file")
    found = numbered_within(placed.where("kind = 'VEVENT'"), "source_index", "offset", "event_index")
    block = F.get(event_blocks(F.concat(F.lit("\n"), unfold("text"))), F.lit(0))
    events, per_event = parse_blocks(found.select("source_index", "source_file", F.col("event_index").cast("int").alias("event_index"), block.alias("block")), limits)
    torn = placed.where("kind in ('UNENDED', 'UNBEGUN')").select("source_index", "source_file", F.lit(None).cast("int").alias("event_index"), F.lit("").alias("event_uid"), F.when(F.col("kind") == "UNENDED", issue("error", "TRUNCATED_COMPONENT", "An event doesn't end.")).otherwise(issue("error", "MALFORMED_EVENT", "An event's end has no beginning.")).alias("i"))
    lines = placed.where("kind = 'OUTSIDE'").groupBy("source_index", "source_file").agg(F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("lines"))
    outside = names.join(lines.drop("source_index"), "source_file", "left").select("source_index", "source_file", F.concat(F.lit("\n"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit(""))).alias("body"))
    is_calendar = F.col("body").contains("\nBEGIN:VCALENDAR")
    whole = outside.select("source_index", "source_file", F.lit(None).cast("int").alias("event_index"), F.lit("").alias("event_uid"), F.explode(F.array_compact(F.array(
        F.when(~is_calendar, issue("error", "MALFORMED_EVENT", "The file isn't a calendar.")), F.when(is_calendar & ~F.col("body").rlike(r"\nEND:VCALENDAR\s*$"), issue("warning", "TRUNCATED_COMPONENT", "The calendar doesn't end.")),
    ))).alias("i"))
    unplaced = per_event.unionByName(torn).unionByName(whole).select("source_index", "source_file", "event_index", "event_uid", "i.severity", "i.code", "i.message")
    calendars = outside.where(is_calendar)
    return Calendars(events.join(calendars.select("source_index"), "source_index", "left_semi"), metadata(calendars), unplaced.withColumn("line", F.lit(None).cast("int")), unplaced)


def parse_blocks(blocks: DataFrame, limits: Limits = LIMITS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Events, and diagnostics as structs `i`, of blocks (source_index, source_file, event_index, block). `keep` takes what both are read from."""
    # what is mentioned often is a column of its own, so that it is worked out once; values and times are found by one lambda for
    # all names, as an expression for each makes methods that are too long for Java to compile
    plain = F.when(F.col("block").contains("BEGIN:V"), F.regexp_replace("block", NESTED, "")).otherwise(F.col("block"))
    parsed = blocks.select("source_index", "source_file", "event_index", F.concat(F.lit("BEGIN:VEVENT\n"), F.col("block"), F.lit("END:VEVENT")).alias("raw"), F.explode(F.array(parse_lines(plain))).alias("p"))
    p = F.col("p")
    each = lambda names, of: let(p["name"], lambda own: F.transform(F.array(*map(F.lit, names)), lambda n: of(F.get(p, (F.array_position(own, n) - 1).cast("int")))))
    both = F.struct(each(VALUES, lambda q: F.coalesce(q["value"], F.lit(""))).alias("values"), each(TIMES, lambda q: let(q, lambda x: F.when(x.isNotNull(), time_of(x)))).alias("times"))
    # exploded, as a condition on a plain column is worked out below it once more
    timed = parsed.select("*", F.explode(F.array(both)).alias("x"))
    value = lambda name: F.get("x.values", F.lit(VALUES.index(name)))
    time = lambda name: F.get("x.times", F.lit(TIMES.index(name)))
    text = lambda name: let(value(name), unescape_text)
    timed = timed.select("*", time("DTSTART").alias("start_time"), time("DTEND").alias("end_time"), time("RECURRENCE-ID").alias("recurrence_id"), value("SEQUENCE").alias("seq"), text("SUMMARY").alias("summary"))
    attendees = F.slice(F.transform(named(p, "ATTENDEE"), person), 1, limits.attendees)
    sequence = F.expr("try_cast(nullif(" + "trim(seq), '') as int)")
    has_start = F.array_contains(p["name"], "DTSTART")
    zoned = F.col("start_time.kind") == "zoned"
    names = F.when(F.size(F.array_distinct(p["name"])) < F.size(p), F.filter(F.array(*map(F.lit, SINGLE)), lambda n: F.size(F.filter(p, lambda x: x["name"] == n)) > 1)).otherwise(F.array().cast("array<string>"))
    found = F.array_compact(F.concat(
        F.array(
            F.when(~has_start, issue("error", "MALFORMED_EVENT", "The event has no start.")),
            F.when(has_start & F.col("start_time").isNull(), issue("error", "INVALID_DATE", "The event's start isn't a real time.")),
            F.when(F.trim(value("UID")) == "", issue("warning", "MISSING_UID", "The event has no UID.")),
            F.when(F.exists(named(p, "RDATE"), lambda x: F.upper(parameter(x, "VALUE")) == "PERIOD"), issue("warning", "UNSUPPORTED_RDATE_PERIOD", "Period dates are kept but not expanded.")),
            F.when(F.size(named(p, "ATTENDEE")) > limits.attendees, issue("error", "LIMIT_EXCEEDED", "The event has too many attendees.")),
            F.when(zoned & ~zone_known(F.col("start_time.tzid")), issue("warning", "UNKNOWN_TIMEZONE", "The event's zone isn't known.")),
            F.when(zoned & F.col("start_time.instant").isNull() & zone_known(F.col("start_time.tzid")), issue("warning", "AMBIGUOUS_LOCAL_TIME", "The local time occurs twice or not at all.")),
        ),
        F.transform(names, lambda n: F.struct(F.lit("warning").alias("severity"), F.lit("DUPLICATE_PROPERTY").alias("code"), F.concat(n, F.lit(" occurs more than once; the first counts.")).alias("message"))),
    ))
    columns = timed.select(
        "source_index", "event_index", "source_file", value("UID").alias("uid"),
        F.when(F.trim("summary") == "", UNTITLED).otherwise(F.col("summary")).alias("title"), text("DESCRIPTION").alias("description"), text("LOCATION").alias("location"),
        F.col("start_time.value").alias("start"), F.coalesce("end_time.value", F.lit("")).alias("end"), "start_time", "end_time", value("DURATION").alias("duration"),
        (F.col("start_time.kind") == "date").alias("all_day"), zone_label(F.col("start_time")).alias("timezone"), F.col("start_time.kind").alias("time_kind"),
        F.coalesce(F.get(F.transform(named(p, "ORGANIZER"), person), F.lit(0)), F.lit("")).alias("organizer"), attendees.alias("attendees"), F.upper(value("STATUS")).alias("status"),
        value("RRULE").alias("rrule"), times_of(p, "RDATE").alias("rdates"), times_of(p, "EXDATE").alias("exdates"), "recurrence_id",
        F.upper(parameter(first(p, "RECURRENCE-ID"), "RANGE")).alias("recurrence_range"), sequence.alias("sequence"),
        time("CREATED").alias("created"), time("LAST-MODIFIED").alias("last_modified"), time("DTSTAMP").alias("dtstamp"),
        F.transform(F.flatten(F.transform(named(p, "CATEGORIES"), lambda x: F.split(x["value"], r"(?<!\\),"))), unescape_text).alias("categories"),
        value("URL").alias("url"), F.replace(value("GEO"), F.lit(";"), F.lit(",")).alias("geo"), p.alias("raw_properties"), "raw", found.alias("found"),
    )
    columns = keep(columns)
    events = columns.where("start_time is not null").drop("found")
    return events, columns.select("source_index", "source_file", "event_index", F.col("uid").alias("event_uid"), F.explode("found").alias("i"))


def zone_known(tz: Column) -> Column:
    from ..functions.time import is_supported_zone

    return is_supported_zone(tz)


def metadata(whole: DataFrame) -> DataFrame:
    """One row per calendar file, of properties outside its components."""
    outer = F.regexp_replace("body", r"(?s)BEGIN:(VEVENT|VTIMEZONE|VTODO|VJOURNAL|VFREEBUSY)\n.*?END:\1\n?", "")
    rows = whole.select("source_index", "source_file", "body", F.explode(F.array(parse_lines(outer))).alias("p"))
    p = F.col("p")
    vendor = F.transform(F.filter(p, lambda x: x["name"].startswith("X-")), lambda x: x["raw"])
    zones = F.regexp_extract_all("body", F.lit(r"(?s)BEGIN:VTIMEZONE\n.*?END:VTIMEZONE"), F.lit(0))
    return rows.select("source_index", "source_file", *(unescape_text(first_value(p, *names)).alias(c) for c, names in METADATA.items()), vendor.alias("vendor_properties"), zones.alias("vtimezones"))


def numbered(events: DataFrame) -> DataFrame:
    """events with `idx`, their place over all files: a file's base is the count of events before it. A file holds at most Limits.events."""
    counts = events.groupBy("source_index").agg(F.count("*").alias("n"))
    bases = running_total(counts, "source_index", "n", "base").select("source_index", "base")
    own = F.row_number().over(Window.partitionBy("source_index").orderBy("event_index")) - 1
    return events.join(bases, "source_index").withColumn("idx", F.col("base") + own).drop("base")


def legacy_blocks(text: Column) -> Column:
    """(headers, events, malformed) of a text: what is before the first event, the event blocks, and how many don't pair up."""
    body = F.concat(F.lit("\n"), plain_ends(text))
    begins, ends = F.regexp_count(body, F.lit(r"\nBEGIN:VEVENT")), F.regexp_count(body, F.lit(r"\nEND:VEVENT"))
    return F.struct(F.ltrim(F.substring_index(body, "\nBEGIN:VEVENT", 1)).alias("headers"), F.regexp_extract_all(body, F.lit(r"(?s)BEGIN:VEVENT.*?END:VEVENT"), F.lit(0)).alias("events"), F.abs(begins - ends).alias("malformed"))


EVENT_TIME = TIME


def recovery(files: DataFrame) -> DataFrame:
    """(source_index, source_file, line, severity, code) of event markers that don't pair up, lines from 1.

    An event that begins before the one before it ended, or that doesn't end,
    is TRUNCATED_COMPONENT at its beginning; an end without one MALFORMED_EVENT.
    """
    lines = F.split(plain_ends(F.coalesce("text", F.lit(""))), "\n")
    marked = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.upper(x).alias("mark"))), lambda m: m["mark"].isin("BEGIN:VEVENT", "END:VEVENT"))

    def told(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after = F.get(m, i - 1)["mark"], F.get(m, i + 1)["mark"]
            torn = (x["mark"] == "BEGIN:VEVENT") & (F.coalesce(after, F.lit("")) != "END:VEVENT")
            lone = (x["mark"] == "END:VEVENT") & (F.coalesce(before, F.lit("")) != "BEGIN:VEVENT")
            return F.struct(x["line"].alias("line"), F.when(torn, "TRUNCATED_COMPONENT").when(lone, "MALFORMED_EVENT").alias("code"))

        return F.filter(F.transform(m, one), lambda x: x["code"].isNotNull())

    return files.select("source_index", "source_file", F.explode(let(marked, told)).alias("x")).select("source_index", "source_file", "x.line", F.lit("error").alias("severity"), "x.code")


def block_lines(text: Column) -> Column:
    """The line, from 1, at which each whole event of a text begins, in order: an event's is that of its ordinal."""
    lines = F.split(plain_ends(text), "\n")
    marked = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.upper(x).alias("mark"))), lambda m: m["mark"].isin("BEGIN:VEVENT", "END:VEVENT"))
    whole = lambda m: F.filter(m, lambda x, i: (x["mark"] == "BEGIN:VEVENT") & (F.get(m, i + 1)["mark"] == "END:VEVENT"))
    return F.transform(let(marked, whole), lambda x: x["line"])
