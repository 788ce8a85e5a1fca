import os

import pytest
from pyspark.sql import functions as F

from kalends.sinks.files import PARTS, ROWS, PartsWriter, assemble, write_calendars, write_files
from kalends.sources.files import FILES
from kalends.sources.ics import numbered, parse_ics


def names(path):
    return sorted(x for x in os.listdir(path) if x != PARTS)


def test_files_of_many_parts(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), (3000 - F.col("id")).alias("position"), F.concat(F.lit("é"), F.col("id"), F.lit("\n")).alias("text"))
    write_files(rows, tmp_path.as_uri())
    assert names(tmp_path) == ["f0", "f1", "f2"] and not os.path.exists(tmp_path / PARTS)
    for k in range(3):
        assert (tmp_path / f"f{k}").read_text() == "".join(f"é{i}\n" for i in range(2999, -1, -1) if i % 3 == k)
    write_files(rows.where("file = 'f1'").limit(0), tmp_path.as_uri())
    write_files(spark.createDataFrame([("f1", 1, "new")], ROWS), tmp_path.as_uri())
    assert (tmp_path / "f1").read_text() == "new" and names(tmp_path) == ["f0", "f1", "f2"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("f").alias("file"), F.col("id").alias("position"), F.when(F.col("id") < 990, "x").otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("text"))
    with pytest.raises(Exception):  # noqa: B017
        write_files(rows, tmp_path.as_uri())
    assert names(tmp_path) == []


def test_repeated_and_killed_attempts_do_not_count(spark, tmp_path):
    (tmp_path / PARTS).mkdir()
    writer = PartsWriter(tmp_path.as_uri())
    first, second = [("a", k, f"{k};") for k in range(5)], [("a", k, f"{k};") for k in range(5, 9)] + [("b", 0, "b")]

    def killed():
        yield from second[:2]
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    writer.write(iter(first))  # an attempt whose result was lost
    writer.commit([writer.write(iter(second)), None, writer.write(iter(first))])
    assert names(tmp_path) == []
    assemble(spark, tmp_path.as_uri())
    assert (tmp_path / "a").read_text() == "".join(f"{k};" for k in range(9)) and (tmp_path / "b").read_text() == "b"
    assert names(tmp_path) == ["a", "b"]


def test_calendars_by_source(spark, tmp_path):
    text = lambda uid: f"BEGIN:VCALENDAR\nVERSION:2.0\nBEGIN:VEVENT\nUID:{uid}\nSUMMARY:t\nDTSTART:20240101T090000\nEND:VEVENT\nEND:VCALENDAR\n"
    events = numbered(parse_ics(spark.createDataFrame([(0, "a.ics", text("u0")), (1, "b.ics", text("u1"))], FILES)).events)
    write_calendars(events, tmp_path.as_uri())
    assert names(tmp_path) == ["a.ics", "b.ics"]
    lines = (tmp_path / "b.ics").read_bytes().decode().split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""] and "UID:u1" in lines and lines.count("BEGIN:VEVENT") == 1
