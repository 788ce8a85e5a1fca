import pytest

from kalends.sources.files import FILES
from kalends.sources.ics import parse_ics


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_diagnostics_have_the_line_of_their_event(spark, end):
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "BEGIN:VEVENT", "UID:a", "SUMMARY:folded", "  over", "  lines", "DTSTART:20240101T090000", "END:VEVENT", "BEGIN:VEVENT", "UID:b", "END:VEVENT",
             "BEGIN:VEVENT", "UID:torn", "BEGIN:VEVENT", "UID:c", "DTSTART:20240230T090000", "END:VEVENT", "BEGIN:VEVENT", "DTSTART:20240101T090000", "END:VEVENT", "END:VCALENDAR", ""]
    files = spark.createDataFrame([(0, "a.ics", end.join(lines)), (1, "b.ics", "none"), (2, "c.ics", None)], FILES)
    got = {(r.source_index, r.code, r.event_uid, r.line) for r in parse_ics(files).diagnostics.collect()}
    assert {(0, "MALFORMED_EVENT", "b", 10), (0, "INVALID_DATE", "c", 15), (0, "MISSING_UID", "", 19), (0, "TRUNCATED_COMPONENT", "", None), (1, "MALFORMED_EVENT", "", None)} <= got
