import datetime as dt

import pytest
from pyspark.sql import functions as F

from kalends.operators import recurrence, series
from kalends.sources.files import FILES
from kalends.sources.ics import numbered, parse_ics

RANGE = ("2024-01-01", "2024-01-31")


def event(*lines, uid="u", start="20240101T090000", title="t"):
    head = [f"UID:{uid}"] if uid else []
    return "\n".join(["BEGIN:VEVENT", *head, f"SUMMARY:{title}", start if start.startswith("DTSTART") else f"DTSTART:{start}", *lines, "END:VEVENT"])


@pytest.fixture
def events(spark):
    def make(*blocks):
        text = "BEGIN:VCALENDAR\nVERSION:2.0\n" + "\n".join(blocks) + "\nEND:VCALENDAR\n"
        return numbered(parse_ics(spark.createDataFrame([(0, "a.ics", text)], FILES)).events)

    return make


def days(x):
    return sorted(r.start.strftime("%d") + ("*" if r.modified else "") + ("!" if r.cancelled else "") for r in x.occurrences.collect())


def codes(x):
    return sorted(r.code for r in x.diagnostics.collect())


def test_the_start_counts_and_exclusions_take_it(events):
    first = event("RRULE:FREQ=WEEKLY;BYDAY=WE;COUNT=4")
    x = series.expand_events(events(first), *RANGE)
    assert days(x) == ["01", "03", "10", "17", "24"] and codes(x) == []
    x = series.expand_events(events(event("RRULE:FREQ=DAILY;COUNT=3", "EXDATE:20240101T090000,20240102T090000", "RDATE:20240110T120000,20240103T090000")), *RANGE)
    assert {(r.start.day, r.occurrence_source, r.status) for r in x.occurrences.collect()} == {(3, "rrule", "Recurring"), (10, "rdate", "RDATE")}


def test_overrides(events):
    master = event("RRULE:FREQ=DAILY;COUNT=5", "DTEND:20240101T103000")
    moved = event("RECURRENCE-ID:20240102T090000", start="20240102T150000", title="moved")
    away = event("RECURRENCE-ID:20240103T090000", start="20240303T150000")
    off = event("RECURRENCE-ID:20240104T090000", "STATUS:CANCELLED", start="20240104T090000")
    twice = event("RECURRENCE-ID:20240102T090000", start="20240102T160000")
    other = event("RECURRENCE-ID:20240120T090000", start="20240120T090000")
    kind = event("RECURRENCE-ID;VALUE=DATE:20240105", start="20240105T090000")
    x = series.expand_events(events(master, moved, away, off, twice, other, kind), *RANGE)
    assert days(x) == ["01", "02*", "04*!", "05", "20*"]
    assert codes(x) == ["DUPLICATE_RECURRENCE_OVERRIDE", "RECURRENCE_OVERRIDE_MISMATCH", "RECURRENCE_TIME_KIND_MISMATCH"]
    rows = {r.recurrence_id: r for r in x.occurrences.collect()}
    assert (rows["2024-01-02T09:00:00"].title, rows["2024-01-02T09:00:00"].occurrence_start, rows["2024-01-02T09:00:00"].status) == ("moved", "2024-01-02T15:00:00", "Modified occurrence")
    assert rows["2024-01-05T09:00:00"].occurrence_end == "2024-01-05T10:30:00" and rows["2024-01-04T09:00:00"].status == "Cancelled"
    assert set(series.RECORD) <= set(x.occurrences.columns)
    assert series.counters(x.series.series).first().asDict() == {"recurring_series": 1, "series_with_exclusions": 0, "series_with_additions": 0, "series_with_overrides": 1, "unsupported_series": 0}


def test_masters_and_cutoffs(events):
    lone = event("RECURRENCE-ID:20240102T090000", uid="lone", start="20240102T150000")
    two = [event("RRULE:FREQ=DAILY;COUNT=2", uid="two"), event("RRULE:FREQ=DAILY;COUNT=2", uid="two", start="20240110T090000"), event("RECURRENCE-ID:20240110T090000", uid="two", start="20240110T093000")]
    future = [event("RRULE:FREQ=DAILY;COUNT=9", uid="f"), event("RECURRENCE-ID;RANGE=THISANDFUTURE:20240104T090000", uid="f", start="20240104T100000")]
    none = event("RRULE:FREQ=DAILY;COUNT=2", uid="")
    x = series.expand_events(events(lone, *two, *future, none, event(uid="single")), *RANGE)
    assert codes(x) == ["DUPLICATE_RECURRENCE_MASTER", "DUPLICATE_RECURRENCE_MASTER", "MISSING_RECURRENCE_MASTER", "RECURRENCE_OVERRIDE_MISMATCH", "UNSUPPORTED_THISANDFUTURE"]
    by = {}
    for r in x.occurrences.collect():
        by.setdefault(r.series_id, []).append(r.start.day)
    # the override of the 10th belongs to the first master, which has no such day
    assert {k: sorted(v) for k, v in by.items()} == {"two::1": [1, 2, 10], "two::2": [10, 11], "f::4": [1, 2, 3], "missing-uid-6::6": [1, 2]}
    assert series.counters(x.series.series).first().unsupported_series == 1
    only = series.expand_events(events(*two), *RANGE, x.series.series.where("uid = 'two'").select("series_id").limit(0))
    assert only.occurrences.count() == 0


def test_rules_that_cannot_be_expanded(events):
    bad = [event(f"RRULE:{r}", uid=r) for r in ("FREQ=DAILY;COUNT=abc", "FREQ=DAILY;INTERVAL=0", "FREQ=NOW", "COUNT=3", "FREQ=DAILY;BYHOUR=25", "FREQ=WEEKLY;BYDAY=XX", "FREQ=DAILY;UNTIL=soon")]
    x = series.expand_events(events(*bad, event("RRULE:FREQ=YEARLY;BYEASTER=1", uid="easter"), event("RRULE:FREQ=SECONDLY", uid="many")), *RANGE)
    assert codes(x) == ["INVALID_RRULE"] * 7 + ["RECURRENCE_LIMIT_REACHED", "UNSUPPORTED_RRULE_PART"]
    assert days(x) == ["01"] * 9
    assert {r.detail for r in x.diagnostics.where("code = 'UNSUPPORTED_RRULE_PART'").collect()} == {"BYEASTER"}


def test_until_is_shown_in_the_series_zone(events):
    zoned = "DTSTART;TZID=America/New_York:20240101T220000"
    x = series.expand_events(events(event("RRULE:FREQ=DAILY;UNTIL=20240104T020000Z", start=zoned)), *RANGE)
    assert days(x) == ["01", "02"]  # two in the morning there is nine in the evening before here
    x = series.expand_events(events(event("RRULE:FREQ=DAILY;BYHOUR=22;UNTIL=20240104T030000Z", start=zoned)), *RANGE)
    assert days(x) == ["01", "02", "03"]
    x = series.expand_events(events(event("RRULE:FREQ=DAILY;UNTIL=20240103")), *RANGE)
    assert days(x) == ["01", "02", "03"]


def test_caps(spark, events):
    from dataclasses import replace

    from kalends.config import LIMITS

    x = series.expand_events(events(*(event("RRULE:FREQ=DAILY;COUNT=6", uid=f"u{i}") for i in range(3))), *RANGE, limits=replace(LIMITS, series_occurrences=4, occurrences=9))
    assert sorted(r["count"] for r in x.occurrences.groupBy("series_id").count().collect()) == [1, 4, 4]
    assert codes(x) == ["RECURRENCE_LIMIT_REACHED"] * 3


def test_rule_texts(spark):
    want = {
        "FREQ=DAILY": "Every day", "FREQ=DAILY;COUNT=1": "Every day for 1 time", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,FR": "Every 2 weeks on Monday, Friday", "FREQ=MONTHLY;BYMONTHDAY=15": "Every month on the 15th",
        "FREQ=MONTHLY;BYDAY=1MO,-1FR": "Every month on the 1st Monday, the last Friday", "FREQ=YEARLY;UNTIL=20260131T000000Z": "Every year until January 31, 2026", "FREQ=MONTHLY;BYMONTHDAY=1,-1": "Every month on the 1st and last",
        "FREQ=DAILY;BYHOUR=3": "Complex recurrence rule", "FREQ=DAILY;COUNT=x": "Complex recurrence rule", "": "Additional dates without an RRULE",
    }
    rows = spark.createDataFrame(list(want.items()), "rule string, want string")
    assert all(r.got == r.want for r in rows.select("want", recurrence.rule_text(F.col("rule")).alias("got")).collect())


def test_groups_are_numbered_in_chunks(spark):
    from kalends.operators.search import numbered_within, running_total

    rows = spark.createDataFrame([(i % 3, i * 7, 1) for i in range(100)], "g int, o long, v int")
    got = sorted((r.g, r.o, r.n) for r in numbered_within(rows, "g", "o", "n", chunk=50).collect())
    assert got == [(g, i * 7, k) for g in range(3) for k, i in enumerate(range(g, 100, 3))]
    assert sorted((r.o, r.t) for r in running_total(rows, "o", "v", "t").collect()) == [(i * 7, i) for i in range(100)]
