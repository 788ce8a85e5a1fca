"""What made written and parsed calendars cost more than once per event."""

import random

import pytest
from pyspark.sql import functions as F

from kalends.functions.text import escape_ics, unfold
from kalends.functions.time import is_supported_zone, zones
from kalends.operators import calendar_merge, event_duplicates
from kalends.plans.queries import QUERIES
from kalends.sinks import ics
from kalends.sources.files import FILES
from kalends.sources.ics import numbered, parse_ics
from kalends.sources.properties import named


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def calendar(*events):
    return "\r\n".join(["BEGIN:VCALENDAR", *(f"BEGIN:VEVENT\r\n{e}\r\nEND:VEVENT" for e in events), "END:VCALENDAR", ""])


def test_calendars_are_written_where_their_events_are_dealt(spark):
    """Events were joined with their table for the user, and their texts shuffled."""
    df = QUERIES["legacy_event_blocks"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_zones_are_searched_in_their_line(spark):
    names = sorted(zones())
    rows = spark.createDataFrame([(n,) for n in [*names, "", None, ";", names[0] + ";" + names[1], "Mars/Base", names[0][:-1]]], "z string")
    assert [r.z for r in rows.where(is_supported_zone(F.col("z"))).collect()] == names


def test_single_lines_and_lists_fold(spark):
    text = calendar("UID:a\r\nDTSTART:20240101T090000\r\nSUMMARY:" + "é" * 60 + "\r\nX-LONG:" + "y" * 200, "UID:b\r\nDTSTART:20240101T090000\r\nSUMMARY:x\r\nX-A:1\r\nRDATE:20240102T090000,20240103T090000")
    e = parse_ics(spark.createDataFrame([(0, "a.ics", text)], FILES)).events.withColumn("idx", F.col("event_index"))
    long, short = (r.text for r in ics.event_text(e, ["idx"]).orderBy("idx").collect())
    assert all(len(x.encode()) <= 75 for x in long.split("\r\n")) and long.count("\r\n ") == 3 and ("X-LONG:" + "y" * 200) in long.replace("\r\n ", "")
    assert short.split("\r\n") == ["BEGIN:VEVENT", "UID:b", "DTSTART:20240101T090000", "SUMMARY:x", "RDATE:20240102T090000", "RDATE:20240103T090000", "X-A:1", "END:VEVENT"]


def test_escapes_and_folds_of_odd_texts(spark):
    rows = spark.createDataFrame([("plain",), ("a;b,c",), ("a\\b",), ("a\r\nb\rc\nd",), ("",)], "s string")
    assert [r[0] for r in rows.select(escape_ics(F.col("s"))).collect()] == ["plain", r"a\;b\,c", r"a\\b", r"a\nb\nc\nd", ""]
    rows = spark.createDataFrame([("a\r\n b\rc\n\td",), ("a\n\n \tb",), ("a\r\r\nb",)], "s string")
    assert [r[0] for r in rows.select(unfold(F.col("s"))).collect()] == ["ab\ncd", "a\n\tb", "a\n\nb"]


def test_times_are_read_once(spark):
    """The condition on an event's start was worked out below its times, from times of its own."""
    text = plan(parse_ics(spark.createDataFrame([(0, "a.ics", "x")], FILES)).events)
    filters = [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("T60" in f for f in filters)


def test_a_merge_parses_once(spark):
    files = spark.createDataFrame([(k, f"{k}.ics", calendar(*(f"UID:{k}-{n}\r\nDTSTART:2024010{n + 1}T090000\r\nSUMMARY:t" for n in range(4)), "UID:bad\r\nDTSTART:x")) for k in range(3)], FILES)
    m = calendar_merge.analyze(files, lambda events: events.where("uid like '%-1'").select("idx"))
    assert not any("BEGIN:VEVENT\n" in plan(df) for df in (m.events, m.summary.select("events", "included"), m.summary.select("sources")))
    row = m.summary.first()
    assert (row.sources, row.events, row.included, row.malformed) == (3, 12, 9, 3)
    assert [r.idx for r in m.events.orderBy("idx").collect()] == list(range(12))
    assert [tuple(r) for r in m.events.select("idx", "uid").orderBy("idx").collect()] == [tuple(r) for r in numbered(parse_ics(files).events).select("idx", "uid").orderBy("idx").collect()]


def some_events(spark, ids):
    rng = random.Random(3)
    some = lambda values: rng.choice(values)
    events = [(i, some([None, "", " u1 ", "u1", "u2", "u\x1f3"]), some([None, "master", "r1"]), some(["A", "a ", "B", None]), some("12"), "", some(["x", "y", None])) for i in ids]
    return spark.createDataFrame(events, "idx long, uid string, identity string, title string, start_key string, end_key string, location string")


def test_what_a_stronger_key_pairs_takes_no_part_in_later_passes(spark, monkeypatch):
    """All seeds were compared in each of up to twenty rounds."""
    given, among = [], event_duplicates.owner_pairs_among

    def counted(seeds, live):
        given.append(seeds.count())
        return among(seeds, live)

    monkeypatch.setattr(event_duplicates, "owner_pairs_among", counted)
    events = some_events(spark, [*range(80), None])
    got = event_duplicates.candidates(events).collect()
    paired = [sum(r.confidence == c for r in got) for c in event_duplicates.CONFIDENCE]
    certain = events.where("trim(coalesce(uid, '')) <> ''").count()
    assert given == [certain, 81 - paired[0], 81 - paired[0] - paired[1]] and min(paired) > 0


@pytest.mark.parametrize("ids", [[*range(90), None], [3 * k % 40 for k in range(90)], [None, None, 1, 1, 2, 3, 2, 5]])
def test_pairs_of_passes_are_those_of_rounds(spark, ids):
    """Ids that repeat, whose rows differ, may hold several keys of a kind."""
    events = some_events(spark, ids)
    rounds = event_duplicates.paired_by_rounds(event_duplicates.with_seeds(events), 20)
    expected = {(r.idx, r.owner, event_duplicates.CONFIDENCE[r["rank"]]) for r in rounds.collect()}
    got = event_duplicates.candidates(events).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_what_is_left_out_is_found_before_a_shuffle(spark):
    """Events were numbered by a window, which their properties went through with them."""
    files = spark.createDataFrame([(k, f"{k}.ics", calendar(*(f"UID:{k}-{n}\r\nDTSTART:2024010{n + 1}T090000\r\nX-N:{n}" for n in range(4)))) for k in (1, 0, 0)], FILES)
    own = F.get(named(F.col("raw_properties"), "X-N"), F.lit(0))["value"]
    left = []
    m = calendar_merge.analyze(files, lambda events: left.append(events.where(own == "1").select("idx")) or left[0])
    text = plan(left[0])
    assert "Window" not in text and "raw_properties" not in text[: text.index("Filter")]
    row = m.summary.first()
    assert (row.sources, row.events, row.included) == (2, 12, 9)
    # files of one number
    assert sorted(r.idx for r in m.events.collect()) == list(range(12))
