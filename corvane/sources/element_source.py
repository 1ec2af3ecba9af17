"""Typed elements of text files as a data source of Spark's own, for batches and streams.

``register(spark)``, then ``spark.read.format("corvane_elements").load(folder)``.
A large file is read in ranges, each of which has the elements whose preceding
blank line begins in it. A task takes ranges one after the other, TASK_BYTES of them, and holds a batch of at most
BATCH_ROWS elements or a little over BATCH_CHARS. Options: ``glob`` (of file names), ``split_bytes`` (of a range), ``max_chars`` (of an element's text).
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SPLIT_BYTES = 64 << 20
#: Bytes of the ranges of a task, if one range is not more; elements and characters that leave it at a time.
TASK_BYTES = 4 << 20
BATCH_ROWS, BATCH_CHARS = 2000, 4 << 20
#: Kinds by the pattern of a text's beginning; what fits none is a title if it is short and no sentence ends it.
KINDS = (("Title", r"#{1,6}\s"), ("Table", r"\|.*\|"), ("ListItem", r"([-*+•]|\d+[.)])\s"))


class Ranges(InputPartition):
    """Ranges (path, start, end) of one task, those of a file one after the other."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)
        self.parts = parts


def kind_of(text: str) -> str:
    for kind, pattern in KINDS:
        if re.match(pattern, text):
            return kind
    return "Title" if len(text) < 80 and not re.search(r"[.!?。！？]$", text) else "NarrativeText"


def elements_between(file, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(position, text) of the elements whose preceding blank line begins at ``start`` or later and before ``end``; the file's first element belongs to position 0."""
    if start:
        file.seek(start - 1)
        file.readline()  # the rest of a line that began before
    blank = 0 if not start else None
    at, lines = file.tell() if start else 0, []
    first = at

    def text() -> str:
        return b"".join(lines).decode("utf-8", "replace").rstrip("\r\n").strip(" ")

    while line := file.readline():
        if line.strip():
            if blank is not None:
                if not lines:
                    first = at
                lines.append(line)
        else:
            if lines:
                yield first, text()
                lines = []
            if at >= end:
                return
            blank = at
        at += len(line)
    if lines:
        yield first, text()


def _found(path: str, glob: str) -> Iterator[tuple[str, int, int]]:
    """(uri, size, time of change) of the files of a folder, hidden ones left out."""
    system, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    listed = [info] if info.type == pyarrow.fs.FileType.File else system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    for f in sorted(listed, key=lambda f: f.path):
        if f.type == pyarrow.fs.FileType.File and not re.match("[._]", f.base_name) and fnmatch.fnmatch(f.base_name, glob):
            yield prefix + f.path, f.size, f.mtime_ns or 0


class _Elements:
    """What batches and streams have in common: ranges of files, and the rows of a range."""

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.most = int(options["max_chars"]) if "max_chars" in options else None
        self.wanted: dict[str, set] = {}

    def ranges(self, files: Iterator[tuple[str, int, int]]) -> list[Ranges]:
        tasks, room = [], 0
        for path, size, _ in files:
            for at in range(0, size, self.split):
                end = min(at + self.split, size)
                if not tasks or room < end - at:
                    tasks.append([])
                    room = TASK_BYTES
                tasks[-1].append((path, at, end))
                room -= end - at
        return [Ranges(parts) for parts in tasks]

    def rows(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        kinds, out, chars = self.wanted.get("kind"), [], 0
        for path, parts in itertools.groupby(task.parts, key=lambda p: p[0]):
            system, own = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
            with system.open_input_file(own) as raw:
                file = io.BufferedReader(raw, 1 << 20)
                for _, start, end in parts:
                    file.seek(start)
                    for position, text in elements_between(file, start, end):
                        kind = kind_of(text)
                        if kinds is None or kind in kinds:
                            out.append((path, position, kind, text[: self.most]))
                            chars += len(text)
                            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                                yield _batch(out)
                                out, chars = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["source", "position", "kind", "text"])


class ElementReader(_Elements, DataSourceReader):
    """A batch. Filters on ``kind`` are taken over, and applied before rows leave Python; one on ``source`` leaves out whole files."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("kind",), ("source",)):
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted.get(name, values)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        sources = self.wanted.get("source")
        return self.ranges(f for f in _found(self.path, self.glob) if sources is None or f[0] in sources) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class ElementStream(_Elements, DataSourceStreamReader):
    """A stream of files that come whole (written elsewhere and moved in). An offset is the time and name of the last file of a batch."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        time, name = max(((f[2], f[0]) for f in _found(self.path, self.glob)), default=(-1, ""))
        return {"time": time, "name": name}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return self.ranges(f for f in _found(self.path, self.glob) if low < (f[2], f[0]) <= high)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class ElementSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_elements"

    def schema(self) -> str:
        return "source string, position long, kind string, text string"

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options)

    def streamReader(self, schema) -> ElementStream:  # noqa: N802
        return ElementStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which has to allow filters in Python data sources for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ElementSource)
