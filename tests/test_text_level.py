import datetime as dt

import pytest
from pyspark.sql import functions as F

from kalends.functions import time as TM
from kalends.operators import calendar_merge, rows, series, zone_text
from kalends.sinks import csv, vcf
from kalends.sources.files import FILES
from kalends.sources.ics import block_lines, numbered, parse_ics, recovery
from kalends.sources.vcf import parse_vcf

TEXT = "\r\n".join(["BEGIN:VEVENT", "DTSTART;TZID=Europe/Lisbon:20260329T013000", "DTEND;TZID=Europe/Lisbon:20261025T013000", "DTSTART:20260101T100000", "DTEND:20260101T110000Z", 'DTSTART;TZID="Nowhere/X":20260101T100000', "DTSTART;VALUE=DATE:20260101", "END:VEVENT"])


def test_zones_of_a_text(spark):
    files = spark.createDataFrame([(0, "a.ics", TEXT)], FILES)
    zones, issues = zone_text.inspect_zones(files)
    assert {r.zone for r in zones.collect()} == {"Europe/Lisbon", "UTC", "Nowhere/X"}
    assert sorted((r.line, r.kind) for r in issues.collect()) == [(2, "nonexistent"), (3, "ambiguous"), (4, "floating"), (6, "unknown")]
    one = files.select(zone_text.assign_zone(F.col("text"), "Asia/Tokyo").alias("a"), zone_text.convert_zone(F.col("text"), "Asia/Tokyo", "America/New_York").alias("c"), zone_text.convert_zone(F.col("text"), "Asia/Tokyo", "UTC").alias("u")).first()
    assert one.a == TEXT.replace("DTSTART:20260101T100000", "DTSTART;TZID=Asia/Tokyo:20260101T100000")
    lines = one.c.split("\r\n")
    assert lines[3:5] == ["DTSTART;TZID=America/New_York:20251231T200000", "DTEND;TZID=America/New_York:20260101T060000"]
    assert lines[1:3] == TEXT.split("\r\n")[1:3] and lines[5:] == TEXT.split("\r\n")[5:]
    assert one.u.split("\r\n")[3] == "DTSTART:20260101T010000Z"


def test_recovery_by_line(spark):
    text = "END:VEVENT\nBEGIN:VEVENT\nx\nBEGIN:VEVENT\nEND:VEVENT\nbegin:vevent\nend:vevent\nBEGIN:VEVENT"
    files = spark.createDataFrame([(0, "a.ics", text), (1, "b.ics", None)], FILES)
    assert sorted((r.line, r.code) for r in recovery(files).collect()) == [(1, "MALFORMED_EVENT"), (2, "TRUNCATED_COMPONENT"), (8, "TRUNCATED_COMPONENT")]
    assert files.where("text is not null").select(block_lines(F.col("text"))).first()[0] == [4, 6]


def calendar(name, *events):
    body = [f"BEGIN:VEVENT\nUID:{u}\nSUMMARY:{t}\nDTSTART:{s}\nEND:VEVENT" for u, t, s in events]
    return "\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", f"X-WR-CALNAME:{name}", "BEGIN:VTIMEZONE", "TZID:Z", f"X-{name}:1", "END:VTIMEZONE", *body, "END:VCALENDAR"])


def test_merge_analysis(spark):
    files = [(0, "a.ics", calendar("A", ("1", "One", "20260101T100000"), ("2", "Two", "20260102T100000"))), (1, "b.ics", calendar("B", ("1", "One", "20260101T100000"), ("3", "Two", "20260102T100000")))]
    m = calendar_merge.analyze(spark.createDataFrame(files, FILES), spark.createDataFrame([(3,)], "idx long"))
    assert m.summary.first().asDict() == {"sources": 2, "events": 4, "candidates": 2, "included": 3, "definitions": 1, "malformed": 0}
    assert {(r.idx, r.owner, r.confidence) for r in m.candidates.collect()} == {(2, 0, "certain"), (3, 1, "likely")}
    assert {(r.code, r.detail) for r in m.diagnostics.collect()} == {("DUPLICATE_UID", "certain"), ("DUPLICATE_CANDIDATE", "likely"), ("CONFLICTING_VTIMEZONE", "z"), ("MIXED_CALENDAR_METADATA", "name")}


def test_expand_event_raises_beyond_its_limit(spark):
    text = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:t\nDTSTART:20260101T100000\nRRULE:FREQ=DAILY;COUNT=4\nEND:VEVENT\nEND:VCALENDAR"
    events = numbered(parse_ics(spark.createDataFrame([(0, "a.ics", text)], FILES)).events)
    assert series.expand_event(events, "2026-01-01", "2026-01-31", 4).count() == 4
    with pytest.raises(ValueError):
        series.expand_event(events, "2026-01-01", "2026-01-31", 3)


def test_displays(spark):
    df = spark.createDataFrame([(["a", "b"], True, None, dt.datetime(2026, 9, 7, 9, 5))], "l array<string>, b boolean, s string, t timestamp")
    assert tuple(df.select(rows.displayed(df, "l"), rows.displayed(df, "b"), rows.displayed(df, "s"), TM.date_shown(F.col("t")), TM.date_shown(F.col("t"), "locale", "Europe/Paris")).first()) == ("a, b", "Yes", "", "2026-09-07T09:05:00.000Z", "7 Sept 2026, 11:05")
    assert rows.label("time_kind") == "Time kind" and rows.label("sourceFile") == "Source File"


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    csv.write_csv(spark.createDataFrame([("é", 1)], "a string, b int").coalesce(1), f"{tmp_path}/x", bom=True)
    (part,) = tmp_path.glob("x/*.csv")
    assert part.read_bytes() == "﻿a,b\r\né,1\r\n".encode()


def test_vendor_properties_are_written_and_merged(spark):
    card = 'BEGIN:VCARD\nVERSION:3.0\nFN:Ann\nTEL;TYPE=cell:+1 555\nitem1.X-LABEL;TYPE=a;X-NO=1:mine\\, too\nitem1.X-LABEL;TYPE=a;X-NO=1:mine\\, too\nX-Y;LANGUAGE="d:e":z\nEND:VCARD'
    c = parse_vcf(spark.createDataFrame([(0, "a.vcf", card)], FILES)).contacts
    lines = vcf.contact_text(c, ["original_index"]).first().text.split("\r\n")
    assert [x for x in lines if "X-" in x] == ["ITEM1.X-LABEL;TYPE=a:mine\\\\\\, too", 'X-Y;LANGUAGE="d:e":z']
    assert "TEL;TYPE=cell;VALUE=text:+1 555" in lines


def test_folding_by_bytes(spark):
    from kalends.functions.text import fold

    def plain(line):
        raw, out, room = line.encode(), [], 75
        while len(raw) > room:
            end = room
            while raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[:end])
            raw, room = raw[end:], 74
        return b"\r\n ".join([*out, raw]).decode()

    lines = ["a" * n for n in (0, 1, 74, 75, 76, 149, 150, 400)] + ["é" * n for n in (37, 38, 100)] + ["日本🤖x" * n for n in (5, 9, 60)] + ["ab\tc " * 40]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r[0] for r in df.select(fold(F.col("x"))).collect()] == [plain(x) for x in lines]


def test_written_files_are_read_back(spark, tmp_path):
    from kalends.operators import contact_merge
    from kalends.sinks import ics
    from kalends.sources.files import admit

    events = numbered(parse_ics(spark.createDataFrame([(0, "a.ics", calendar("A", *((str(i), f"T{i}", "20260101T100000") for i in range(30))))], FILES)).events)
    ics.write_calendar(events, f"{tmp_path}/ics", "Name")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "ics").glob("part-*")))
    back = parse_ics(spark.createDataFrame([(0, "b.ics", text)], FILES))
    assert [r.uid for r in back.events.orderBy("event_index").collect()] == [str(i) for i in range(30)] and back.metadata.first().name == "Name"
    cards = "\n".join(f"BEGIN:VCARD\nVERSION:3.0\nFN:N{i}\nEND:VCARD" for i in range(5))
    c = parse_vcf(spark.createDataFrame([(0, "a.vcf", cards)], FILES)).contacts
    for original, version in ((True, "3.0"), (False, "4.0")):
        vcf.write_contacts(c, f"{tmp_path}/vcf{version}", original)
        text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / f"vcf{version}").glob("part-*")))
        got = parse_vcf(spark.createDataFrame([(0, "b.vcf", text)], FILES)).contacts
        assert [(r.formatted_name, r.version) for r in got.orderBy("original_index").collect()] == [(f"N{i}", version) for i in range(5)]
    (tmp_path / "in").mkdir()
    for name in ("b.ics", "a.ics", "c.ics", "d.txt"):
        (tmp_path / "in" / name).write_text("BEGIN:VCALENDAR")
    from dataclasses import replace

    from kalends.config import LIMITS

    files, rejected = admit(spark, f"{tmp_path}/in", ".ics", replace(LIMITS, files=2))
    assert sorted((r.source_index, r.source_file) for r in files.collect()) == [(0, "a.ics"), (1, "b.ics")]
    assert {(r.source_file, r.message) for r in rejected.collect()} == {("c.ics", "There are too many files."), ("d.txt", "The file type isn't supported.")}
    groups = spark.createDataFrame([(0, True), (1, True), (2, False)], "group long, exact boolean")
    log = spark.createDataFrame([(4, 1, "keep")], "seq long, group long, type string")
    assert [tuple(r) for r in contact_merge.resolve_exact(groups, log).collect()] == [(5, 0, "merge")]
