"""Calendar and contact files by byte ranges, so that one file is read by many tasks.

A data source whose splits find their own beginning. A component (an event or
a card) belongs to the split in which its BEGIN line starts, and is read to its
end, over the split's own end if need be. A split can begin within a component,
a folded line, or a quoted-printable value, in which a line may even look like
BEGIN. So it looks back for a marker that is one for certain, and reads on from
there to know where it stands; that is about a component's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: offset is the byte at which the component, or the line outside components, starts. `kind` is the component's name,
#: OUTSIDE for a line outside, UNENDED or UNBEGUN for a marker without its counterpart, which has no text.
COMPONENTS = "source_file string, offset long, kind string, text string"
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 18
LINE_END = re.compile(rb"\r\n|\n|\r")
SOFT = re.compile(rb"[^:]*QUOTED-PRINTABLE[^:]*:.*=", re.IGNORECASE | re.DOTALL)


def physical_lines(file: BinaryIO, at: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(start, line, line end) from a line's start on."""
    file.seek(at)
    held, ended = b"", False
    while True:
        place = 0
        for m in LINE_END.finditer(held):
            if m.end() == len(held) and not ended and m[0] == b"\r":
                break  # a line feed may follow
            yield at + place, held[place : m.start()], m[0]
            place = m.end()
        if ended:
            if place < len(held):
                yield at + place, held[place:], b""
            return
        held, at = held[place:], at + place
        more = file.read(READ_BYTES)
        held, ended = held + more, not more


def logical_lines(file: BinaryIO, at: int, soft: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(start, the line as unfolded, its bytes) from a logical line's start on; soft: lines go on after quoted-printable soft breaks."""
    start, line, raw, broken = at, None, b"", False
    for begin, own, end in physical_lines(file, at):
        if line is not None and (broken or own[:1] in (b" ", b"\t")):
            line += own if broken else own[1:]
            raw += own + end
            broken = broken and own.endswith(b"=")
            continue
        if line is not None:
            yield start, line, raw
        start, line, raw = begin, own, own + end
        broken = bool(soft and own.endswith(b"=") and SOFT.fullmatch(own))
    if line is not None:
        yield start, line, raw


def marker(line: bytes, name: bytes) -> int:
    """1 for a component's BEGIN line, -1 for its END, 0 for others."""
    if len(line) > len(name) + 64:
        return 0
    own = line.rstrip(b" \t").upper()
    return 1 if own == b"BEGIN:" + name else -1 if own == b"END:" + name else 0


def certain(file: BinaryIO, before: int, name: bytes) -> int:
    """The start of the last marker line before a place that can be no part of another line, or 0."""
    pattern = re.compile(rb"(?:\A|(?<=[\r\n]))(?:BEGIN|END):" + name + rb"[ \t]*(?=[\r\n]|\Z)", re.IGNORECASE)
    back = READ_BYTES
    while True:
        low = max(0, before - back)
        file.seek(low)
        # bytes before a line decide whether it is one; a line feed after low may be half of a line end
        held = file.read(before - low)
        for m in reversed(list(pattern.finditer(held))):
            if not m.start():
                if low == 0:
                    return 0
            elif (low == 0 or m.start() > 3) and not held[: m.start()].rstrip(b"\r\n").endswith(b"="):
                return low + m.start()
        if low == 0:
            return 0
        back *= 4


def components(file: BinaryIO, low: int, high: int, name: str) -> Iterator[tuple[int, str, str | None]]:
    """(offset, kind, text) of what starts in [low, high) of a file."""
    own, soft = name.encode(), name == "VCARD"
    text = lambda raw: raw.decode("utf-8", "replace")
    opened, parts = None, []
    for start, line, raw in logical_lines(file, certain(file, low, own) if low else 0, soft):
        if start == 0 and line.startswith(b"\xef\xbb\xbf"):
            line, raw = line[3:], raw[3:]
        kind = marker(line, own)
        mine = low <= start < high
        if kind > 0:
            if opened is not None and low <= opened < high:
                yield opened, "UNENDED", None
            if start >= high:
                return
            opened, parts = start, [raw]
        elif kind < 0:
            if opened is None:
                if mine:
                    yield start, "UNBEGUN", None
            elif opened >= low:
                yield opened, name, text(b"".join([*parts, raw]))
            opened, parts = None, []
        elif opened is not None:
            if opened >= low:
                parts.append(raw)
        elif mine:
            yield start, "OUTSIDE", text(line)
        if start >= high and (opened is None or opened < low):
            return
    if opened is not None and low <= opened < high:
        yield opened, "UNENDED", None


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int


class ComponentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("component", "VEVENT")
        self.extension, self.size = options.get("extension", ""), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file] if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        own = sorted((i.path, i.size) for i in found if i.path.lower().endswith(self.extension) and i.size)
        return [Split(p, at, min(size, at + self.size)) for p, size in own for at in range(0, size, self.size)] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[tuple]:
        from pyarrow import fs

        if split.path:
            files, _ = fs.FileSystem.from_uri(self.path)
            with files.open_input_file(split.path) as file:
                for found in components(file, split.low, split.high, self.name):
                    yield (split.path, *found)


class ComponentSource(DataSource):
    """Options: path (a file or folder, as a URI or absolute), component (VEVENT or VCARD), extension, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "kalends-components"

    def schema(self) -> str:
        return COMPONENTS

    def reader(self, schema) -> ComponentReader:
        return ComponentReader(self.options)


def read_components(spark: SparkSession, path: str, component: str = "VEVENT", extension: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """COMPONENTS rows of the files below a path, each file read by one task per split_bytes. Files of any size, no caps."""
    spark.dataSource.register(ComponentSource)
    return spark.read.format("kalends-components").option("component", component).option("extension", extension).option("splitBytes", str(split_bytes)).load(path)
