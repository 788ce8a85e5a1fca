"""Text files written by many tasks each, that appear whole or not at all.

A data source that tasks write parts to. A part has a name of its own, so an
attempt that is killed or repeated harms none; only the parts that the commit
names count, in a manifest that is moved into place when it is complete. Then a
task per file puts its parts together, beside the name they get at last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ics import HEAD, event_text

ROWS = "file string, position long, text string"
MANIFEST, PARTS, COPY_BYTES = "manifest.json", "_parts", 1 << 20


def folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def put(files, path: str, data: bytes) -> None:
    """The file with these bytes, there at once or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(data)
    files.move(temporary, path)


@dataclass
class Written(WriterCommitMessage):
    """Parts of a task: (file, first position, part)."""

    parts: list[tuple[str, int, str]]


class PartsWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        files, base = folder(self.path)
        parts, last, out = [], None, None
        try:
            for file, position, text in rows:
                if file != last:
                    if out:
                        out.close()
                    part = uuid.uuid4().hex
                    last, out = file, files.open_output_stream(f"{base}/{PARTS}/{part}")
                    parts.append((file, position, part))
                out.write(text.encode())
        finally:
            if out:
                out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = folder(self.path)
        found: dict[str, list] = {}
        for m in messages:
            for file, position, part in m.parts if m else []:
                found.setdefault(file, []).append((position, part))
        put(files, f"{base}/{PARTS}/{MANIFEST}", json.dumps({file: [p for _, p in sorted(parts)] for file, parts in sorted(found.items())}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, base = folder(self.path)
        for m in messages:
            for _, _, part in m.parts if m else []:
                files.delete_file(f"{base}/{PARTS}/{part}")


class PartsSource(DataSource):
    """Option: path, a folder as a URI. Rows are ROWS, in ranges of (file, position), sorted."""

    @classmethod
    def name(cls) -> str:
        return "kalends-parts"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Files of ROWS below path, a URI of a folder that all executors reach: each file's texts in the order of their positions.

    A file of any size is written by as many tasks as its rows' ranges have;
    the manifest has a name per part, and no text. A failed job leaves no file;
    files of the same names are replaced, others stay.
    """
    spark = rows.sparkSession
    files, base = folder(path)
    files.create_dir(f"{base}/{PARTS}", recursive=True)
    spark.dataSource.register(PartsSource)
    ordered = rows.select("file", F.col("position").cast("long").alias("position"), "text").where("text is not null")
    ordered = ordered.repartitionByRange("file", "position").sortWithinPartitions("file", "position")
    ordered.write.format("kalends-parts").mode("append").option("path", path).save()
    assemble(spark, path)


def assemble(spark: SparkSession, path: str) -> None:
    """Puts the parts of the manifest together; it may be repeated until it has been done."""
    files, base = folder(path)
    with files.open_input_stream(f"{base}/{PARTS}/{MANIFEST}") as f:
        found = json.loads(f.read())
    if not found:
        return

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                temporary = f"{base}/{PARTS}/{uuid.uuid4().hex}"
                with files.open_output_stream(temporary) as out:
                    for part in row["parts"]:
                        with files.open_input_stream(f"{base}/{PARTS}/{part}") as f:
                            while data := f.read(COPY_BYTES):
                                out.write(data)
                files.move(temporary, f"{base}/{row['file']}")
            yield batch.select(["file"])

    todo = spark.createDataFrame(list(found.items()), "file string, parts array<string>")
    done = todo.repartition(min(len(found), 1000), "file").mapInArrow(join, "file string").count()
    if done != len(found):
        raise RuntimeError("a file wasn't put together")
    files.delete_dir(f"{base}/{PARTS}")


def write_calendars(events: DataFrame, path: str) -> None:
    """A calendar per source_file of the events, by idx."""
    texts = event_text(events, ["source_file", "idx"]).select(F.col("source_file").alias("file"), F.col("idx").cast("long").alias("position"), F.concat("text", F.lit("\r\n")).alias("text"))
    names = events.select(F.col("source_file").alias("file")).distinct()
    ends = names.select("file", F.inline(F.array(*(F.struct(F.lit(at).cast("long").alias("position"), F.lit(text + "\r\n").alias("text")) for at, text in ((-1, HEAD), (2**62, "END:VCALENDAR"))))))
    write_files(texts.unionByName(ends), path)
