import io
import random

import pytest

from kalends.sources import ics, splits, vcf
from kalends.sources.files import FILES
from kalends.sources.splits import components, read_components

END = ["\r\n", "\n", "\r"]


def calendar(rng, n):
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "X-WR-CALNAME:Tëst", "PRODID:-//x//y"]
    for i in range(n):
        lines += ["BEGIN:VEVENT", f"UID:u{i}", f"SUMMARY:Title é {i} " + "long\n  " * rng.randint(0, 3) + "end", f"DTSTART:202401{i % 28 + 1:02d}T090000"]
        if i % 9 == 4:
            lines += ["BEGIN:VALARM", "TRIGGER:-PT5M", "END:VALARM"]
        lines += [] if i % 17 == 11 else ["END:VEVENT"]
        if i % 5 == 0:
            lines += [f"X-EXTRA-{i}:outside"]
        if i % 23 == 7:
            lines += ["END:VEVENT"]
    return "\n".join([*lines, "END:VCALENDAR"]) + "\n"


def address_book(rng, n):
    lines = []
    for i in range(n):
        lines += ["begin:vcard" if i % 4 else "BEGIN:VCARD  ", "VERSION:3.0", f"FN:Ñame {i}", f"EMAIL:a{i}@b.de"]
        if i % 3 == 0:
            lines += ["NOTE;ENCODING=QUOTED-PRINTABLE:one=", "BEGIN:VCARD=", "END:VCARD=", "done=20"]
        if i % 7 == 0:
            lines += ["NOTE:folded", " BEGIN:VCARD", "\tEND:VCARD"]
        lines += ["END:VCA", " RD"] if i % 11 == 5 else [] if i % 13 == 6 else ["END:VCARD"]
    return "\n".join(lines)


@pytest.mark.parametrize("make, name", [(calendar, "VEVENT"), (address_book, "VCARD")])
def test_any_splits_give_the_same_components(make, name, monkeypatch):
    monkeypatch.setattr(splits, "READ_BYTES", 97)
    for seed in range(6):
        rng = random.Random(seed)
        data = make(rng, 60).replace("\n", END[seed % 3]).encode()
        data = b"\xef\xbb\xbf" + data if seed % 2 else data
        whole = list(components(io.BytesIO(data), 0, len(data), name))
        assert sum(k == name for _, k, _ in whole) > 40 and any(k == "UNENDED" for _, k, _ in whole)
        for size in (1, 7, 40, 101, len(data) // 50):
            if size > 1 or seed == 0:
                parts = [x for low in range(0, len(data), size) for x in components(io.BytesIO(data), low, min(len(data), low + size), name)]
                assert parts == whole, (seed, size)


def test_a_file_in_fifty_splits_gives_the_events_of_one(spark, tmp_path):
    text = calendar(random.Random(3), 120).replace("\n", "\r\n")
    (tmp_path / "a.ics").write_bytes(text.encode())
    (tmp_path / "b.ics").write_text("no calendar")
    (tmp_path / "c.txt").write_text("other")
    rows = read_components(spark, tmp_path.as_uri(), extension=".ics", split_bytes=len(text) // 50)
    assert rows.rdd.getNumPartitions() > 50
    got = ics.parse_components(rows)
    want = ics.parse_ics(spark.createDataFrame([(0, "a.ics", text), (1, "b.ics", "no calendar")], FILES))
    columns = ["source_index", "uid", "title", "start", "start_time", "raw_properties"]
    events = lambda c: [tuple(r) for r in c.events.orderBy("source_index", "event_index").select(*columns).collect()]
    assert events(got) == events(want) and len(events(got)) > 100
    meta = lambda c: [r.asDict() for r in c.metadata.drop("source_file", "body").collect()]
    assert [(m["version"], m["name"], len(m["vendor_properties"])) for m in meta(got)] == [("2.0", "Tëst", 24)]
    codes = {(r.source_index, r.code) for r in got.diagnostics.collect()}
    assert {(0, "TRUNCATED_COMPONENT"), (0, "MALFORMED_EVENT"), (1, "MALFORMED_EVENT")} <= codes


def test_cards_in_splits(spark, tmp_path):
    text = address_book(random.Random(1), 90)
    (tmp_path / "a.vcf").write_text(text)
    got = vcf.parse_components(read_components(spark, (tmp_path / "a.vcf").as_uri(), "VCARD", split_bytes=150))
    want = vcf.parse_vcf(spark.createDataFrame([(0, "a.vcf", text)], FILES))
    rows = lambda c: [(r.formatted_name, r.emails[0].value, r.notes) for r in c.contacts.orderBy("original_index").collect()]
    assert rows(got) == rows(want) and len(rows(got)) > 70


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    rows = read_components(spark, tmp_path.as_uri(), extension=".ics")
    assert rows.collect() == [] and ics.parse_components(rows).events.collect() == [] and vcf.parse_components(rows).diagnostics.collect() == []
