import datetime as dt

import pytest
from pyspark.sql import functions as F

from kalends.functions import time as TM
from kalends.operators import calendar_merge, event_duplicates, recurrence, rows, search, timezones
from kalends.sinks import ics
from kalends.sources.files import FILES, admit
from kalends.sources.ics import numbered, parse_ics
from kalends.streaming.calendars import stream_events

CALENDAR = r"""BEGIN:VCALENDAR
VERSION:2.0
X-WR-CALNAME:Team
X-VENDOR:yes
BEGIN:VTIMEZONE
TZID:Europe/Lisbon
END:VTIMEZONE
BEGIN:VEVENT
UID:one
DTSTART;TZID=Europe/Lisbon:20260808T120000
DTEND;TZID=Europe/Lisbon:20260808T130000
SUMMARY:Plan\, review\; talk
DESCRIPTION:first line\nsecond
 folded
ATTENDEE;CN="Ann; B":mailto:ann@example.com
CATEGORIES:work,fun
SEQUENCE:2
X-COLOR:red
BEGIN:VALARM
SUMMARY:not this
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:two
DTSTART;VALUE=DATE:20260809
RRULE:FREQ=DAILY;COUNT=3
EXDATE;VALUE=DATE:20260810,20260811
SUMMARY:
END:VEVENT
BEGIN:VEVENT
UID:bad
DTSTART:20261340T000000Z
END:VEVENT
BEGIN:VEVENT
DTSTART:20260810T090000
SUMMARY:Floating
SUMMARY:again
END:VEVENT
BEGIN:VEVENT
UID:nz
DTSTART;TZID=Mars/Base:20260810T090000
SUMMARY:Mars
RDATE;VALUE=PERIOD:20260811T090000Z/PT1H
END:VEVENT
BEGIN:VEVENT
UID:utc
DTSTART:20260810T090000Z
GEO:1.5;2.5
END:VEVENT
END:VCALENDAR
"""


@pytest.fixture
def calendar(spark):
    texts = [(0, "a.ics", CALENDAR.replace("\n", "\r\n")), (1, "b.ics", CALENDAR.split("END:VEVENT")[0]), (2, "c.ics", "hello"), (3, "d.ics", None)]
    return parse_ics(spark.createDataFrame(texts, FILES))


def test_events(calendar):
    got = {r.uid: r for r in calendar.events.where("source_index = 0").collect()}
    assert set(got) == {"one", "two", "", "nz", "utc"}
    one = got["one"]
    assert (one.title, one.description, one.attendees, one.categories, one.sequence) == ("Plan, review; talk", "first line\nsecondfolded", ["Ann; B <ann@example.com>"], ["work", "fun"], 2)
    assert (one.start, one.timezone, one.time_kind, one.start_time.instant) == ("2026-08-08T12:00:00", "Europe/Lisbon", "zoned", dt.datetime(2026, 8, 8, 11))
    two = got["two"]
    assert (two.title, two.all_day, two.timezone, [t.value for t in two.exdates]) == ("(Untitled event)", True, "All-day", ["2026-08-10", "2026-08-11"])
    assert two.start_time.instant is None and got[""].start_time.instant is None and got["nz"].start_time.instant is None
    assert (got[""].timezone, got["utc"].timezone, got["utc"].geo, got["nz"].rdates) == ("Floating", "UTC", "1.5,2.5", [])


def test_diagnostics_and_metadata(calendar):
    got = {(r.source_file, r.code) for r in calendar.diagnostics.collect()}
    assert got >= {("a.ics", "INVALID_DATE"), ("a.ics", "MISSING_UID"), ("a.ics", "DUPLICATE_PROPERTY"), ("a.ics", "UNKNOWN_TIMEZONE"), ("a.ics", "UNSUPPORTED_RDATE_PERIOD"), ("b.ics", "TRUNCATED_COMPONENT"), ("c.ics", "MALFORMED_EVENT"), ("d.ics", "MALFORMED_EVENT")}
    m = calendar.metadata.where("source_index = 0").first()
    assert (m.name, m.version, m.vendor_properties, len(m.vtimezones)) == ("Team", "2.0", ["X-WR-CALNAME:Team", "X-VENDOR:yes"], 1)
    assert calendar_merge.merged_metadata(calendar.metadata).first()["name"] == "Team"
    assert {r.idx for r in numbered(calendar.events).collect()} == set(range(5))


def test_round_trip_and_folding(spark, calendar):
    long = calendar.events.where("source_index = 0").withColumn("description", F.repeat(F.lit("é, "), 60))
    texts = ics.event_text(long.withColumn("idx", F.col("event_index")), ["idx"])
    text = "\r\n".join(r.text for r in texts.orderBy("idx").collect())
    assert max(len(x.encode()) for x in text.split("\r\n")) <= 75
    back = parse_ics(spark.createDataFrame([(0, "x.ics", "BEGIN:VCALENDAR\r\n" + text + "\r\nEND:VCALENDAR")], FILES)).events
    keep = ["uid", "title", "description", "start", "end", "timezone", "rrule", "attendees", "categories", "sequence", "exdates"]
    assert back.select(*keep).orderBy("start", "uid").collect() == long.select(*keep).orderBy("start", "uid").collect()
    assert "X-COLOR:red" in text and "VALUE=PERIOD" in text


def test_admission_and_stream(spark, tmp_path):
    (tmp_path / "ok.ics").write_bytes(b"\xef\xbb\xbf" + CALENDAR.encode())
    (tmp_path / "empty.ics").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    files, rejected = admit(spark, str(tmp_path), ".ics")
    assert [(r.source_index, r.source_file, r.text[:5]) for r in files.collect()] == [(0, "ok.ics", "BEGIN")]
    assert {r.source_file for r in rejected.collect()} == {"other.txt"}
    q = stream_events(spark, str(tmp_path)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("streamed").where("uid = 'one'").count() == 1


@pytest.mark.parametrize(("zone", "wall", "status"), [("Europe/Lisbon", "2026-03-29 01:30:00", "nonexistent"), ("Europe/Lisbon", "2026-10-25 01:30:00", "ambiguous"), ("America/New_York", "2026-03-08 02:30:00", "nonexistent"), ("America/New_York", "2026-11-01 01:30:00", "ambiguous"), ("Asia/Kolkata", "2026-11-01 01:30:00", "valid")])
def test_wall_times(spark, zone, wall, status):
    n = F.lit(wall).cast("timestamp_ntz")
    assert spark.range(1).select(TM.wall_status(TM.wall_instants(n, F.lit(zone)))).first()[0] == status


def test_zone_transform_table(calendar):
    e = calendar.events.where("source_index = 0")
    got = {r.uid: (r.result, r.code, r.new_start.value) for r in timezones.preview(e, "convert", "America/New_York").collect()}
    assert got == {"one": ("changed", "", "2026-08-08T07:00:00"), "two": ("unchanged", "", "2026-08-09"), "": ("warning", "TIMEZONE_CONVERSION_UNSAFE", "2026-08-10T09:00:00"), "nz": ("blocked", "UNKNOWN_TIMEZONE", "2026-08-10T09:00:00"), "utc": ("changed", "", "2026-08-10T05:00:00")}
    got = {r.uid: (r.result, r.new_start.kind, r.new_start.instant) for r in timezones.preview(e, "assign", "Asia/Tokyo").collect()}
    assert got[""] == ("changed", "zoned", dt.datetime(2026, 8, 10, 0)) and got["one"][0] == "unchanged"
    assert {r.code for r in timezones.preview(e, "assign", "No/Where").where("uid = ''").collect()} == {"UNKNOWN_TIMEZONE"}
    a = timezones.analyze(e).first()
    assert (a.total, a.utc, a.zoned, a.floating, a.date, a.unknown, a.zones["UTC"]) == (5, 1, 2, 1, 1, 1, 1)
    assert timezones.result_counts(timezones.preview(e, "inspect")).first().unchanged == 5


RULES = [
    ("FREQ=DAILY;COUNT=5", ["01", "02", "03", "04", "05"]),
    ("FREQ=DAILY;INTERVAL=10", ["01", "11", "21", "31"]),
    ("FREQ=WEEKLY;UNTIL=20260815", ["01", "08", "15"]),
    ("FREQ=WEEKLY;BYDAY=MO,FR;COUNT=4", ["03", "07", "10", "14"]),
    ("FREQ=MONTHLY;BYDAY=1MO,-1FR", ["03", "28"]),
    ("FREQ=MONTHLY;BYSETPOS=-1;BYDAY=MO,TU,WE,TH,FR", ["31"]),
    ("FREQ=YEARLY;BYEASTER=1", []),
    ("FREQ=SECONDLY", []),
]


def test_rules(spark):
    s = spark.createDataFrame([(str(k), dt.datetime(2026, 8, 1, 9), r) for k, (r, _) in enumerate(RULES)], "series_id string, dtstart timestamp_ntz, rrule string")
    got = {}
    for r in recurrence.expand_rules(s, "2026-08-01", "2026-08-31").collect():
        got.setdefault(int(r.series_id), []).append(r.start.strftime("%d"))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in enumerate(RULES) if v}
    with pytest.raises(ValueError, match="days"):
        recurrence.expand_rules(s, "2026-08-31", "2026-08-01")


def test_caps_cutoffs_and_ends(spark):
    o = spark.createDataFrame([(s, dt.datetime(2026, 8, d), d) for s in "ab" for d in range(1, 8)], "series_id string, start timestamp_ntz, identity int")
    got = recurrence.capped(o, per_series=5, total=7)
    assert [(r.series_id, r["count"]) for r in got.groupBy("series_id").count().orderBy("series_id").collect()] == [("a", 5), ("b", 2)] and got.where("not truncated").count() == 0
    cut = spark.createDataFrame([("a", dt.datetime(2026, 8, 3))], "series_id string, cutoff timestamp_ntz")
    assert recurrence.this_and_future(o, cut).count() == 9
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    assert spark.range(1).select(recurrence.occurrence_end(t("2026-08-02 09:00:00"), t("2026-08-01 09:00:00"), t("2026-08-01 10:30:00"), F.lit(None).cast("long"))).first()[0] == dt.datetime(2026, 8, 2, 10, 30)


def ordered_pairs(events):
    """The rule in plain words: owners for ever, one pair per event, paired events don't register the rest."""
    owners, out = {}, []
    for idx, uid, inst, title, start, loc in events:
        seeds = [("c", uid, inst)] if uid else []
        seeds += [("l", title.lower(), start, "", loc.lower()), ("p", title.lower(), start)]
        ranks = [0, 1, 2] if uid else [1, 2]
        for rank, key in zip(ranks, seeds, strict=True):
            prior = owners.get(key)
            if prior is None:
                owners[key] = (idx, uid, inst)
                continue
            if uid and prior[1] == uid and prior[2] != inst:
                continue
            out.append((idx, prior[0], event_duplicates.CONFIDENCE[rank]))
            break
    return out


def test_candidates_follow_the_order(spark):
    import random

    rng = random.Random(7)
    events = [(i, rng.choice(["", "", "u1", "u2"]), rng.choice(["master", "r1"]), rng.choice(["A", "B", "C"]), rng.choice("12"), rng.choice("xy")) for i in range(60)]
    df = spark.createDataFrame(events, "idx long, uid string, identity string, title string, start_key string, location string").withColumn("end_key", F.lit(""))
    got = sorted(map(tuple, event_duplicates.candidates(df).select("idx", "owner", "confidence").collect()))
    assert got == ordered_pairs(events)


def test_rows_and_search(calendar):
    e = calendar.events.where("source_index = 0")
    assert rows.event_rows(e).columns == rows.EVENT_COLUMNS
    with pytest.raises(ValueError, match="column"):
        rows.event_rows(e, [])
    assert [r.uid for r in search.search_events(e, "ANN@example").collect()] == ["one"]
    assert [r.uid for r in search.search_events(e, recurring=True).collect()] == ["two"]
    assert rows.messages(calendar.diagnostics).where("message like '%INVALID_DATE%'").count() == 1
