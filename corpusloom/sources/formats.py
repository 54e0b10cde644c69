"""Record formats as Spark data sources: spark.read.format("columns" | "brackets" | "examples").load(path).

A format says how a record is delimited (a line, or a block of lines between empty ones) and what rows it holds; a format of
one's own is a subclass of RecordSource, registered with register(). Files are cut into ranges of bytes. A record belongs to the range in which
its first byte lies, and the task of that range reads it to its end, so none is lost or read twice, wherever the cuts fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, where the option `rangeBytes` says nothing.
RANGE = 32 << 20
_CHUNK = 1 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


def _files(path: str):
    """(file system, [(path, size)]) of a file or of all files below a folder, but those whose name begins with . or _."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
    return store, sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")


def _lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines from a place that begins one."""
    file.seek(start)
    at, held = start, b""
    while True:
        chunk = file.read(_CHUNK)
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
        if not chunk:
            if held:
                yield at, held
            return


def _line_start(file, at: int) -> int | None:
    """The first place from `at` on that begins a line; None where there is none."""
    if at == 0:
        return 0
    file.seek(at - 1)
    while chunk := file.read(_CHUNK):
        if (found := chunk.find(b"\n")) >= 0:
            return file.tell() - len(chunk) + found + 1
    return None


def _after_blank(file, at: int) -> bool:
    """Whether the line that ends before `at` is empty."""
    if at == 0:
        return True
    begin, line = at - 1, b""
    while begin > 0:
        step = max(0, begin - 256)
        file.seek(step)
        part = file.read(begin - step)
        line = part + line
        if b"\n" in part or line.strip():
            return not line.rpartition(b"\n")[2].strip()
        begin = step
    return not line.strip()


def records(file, start: int, stop: int, blocks: bool) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, lines) of the records that begin in a range of bytes: each line that isn't empty, or each block of such lines."""
    first = _line_start(file, start)
    if first is None:
        return
    open_, held, fresh = first, [], not blocks or _after_blank(file, first)
    for at, line in _lines(file, first):
        line = line.removesuffix(b"\r")
        if at >= stop and not held:
            return
        if not line.strip():
            if held:
                yield open_, held
            held, fresh = [], True
        elif held and blocks:
            held.append(line)
        elif fresh:
            if held:
                yield open_, held
                held = []
            if at >= stop:
                return
            open_, held = at, [line]
    if held:
        yield open_, held


class RecordReader(DataSourceReader):
    def __init__(self, source: RecordSource):
        self.source, self.path, self.size = source, source.options["path"], int(source.options.get("rangebytes", source.options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(path, at, min(at + self.size, size)) for path, size in _files(self.path)[1] for at in range(0, size, self.size)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if partition.path:
            with _files(self.path)[0].open_input_file(partition.path) as file:
                for offset, lines in records(file, partition.start, partition.stop, self.source.blocks):
                    for row in self.source.rows([x.decode("utf-8", "replace") for x in lines]):
                        yield (partition.path, offset, *row)


class RecordSource(DataSource):
    """A format: `kind`, its name; `blocks`, whether a record is a block of lines or one line; `columns`, the schema of its rows; and
    rows(), which turns the lines of a record into rows. Rows also have `path` and `offset`, the record's first byte."""

    kind, blocks, columns = "", False, ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"path string, offset long, {self.columns}"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self)

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        raise NotImplementedError


class Columns(RecordSource):
    """Fields between white space, a line for each word; an empty line ends a sentence."""

    kind, blocks, columns = "columns", True, "pos int, fields array<string>"

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        for pos, line in enumerate(lines):
            yield pos, re.findall(r"[^\t-\r ]+", line)


class Brackets(RecordSource):
    """`(tag word) (tag word)`: a sentence on each line; what is no such pair has no row."""

    kind, blocks, columns = "brackets", False, "pos int, tag string, form string"

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        for pos, found in enumerate(re.findall(r"\(([^\s()]+) ([^\s()]+)\)", lines[0])):
            yield pos, *found


class NamedBrackets(Brackets):
    """Bracketed sentences whose first pair names them: each word has that pair's form beside it, so that no join is needed to find it."""

    kind, columns = "named_brackets", f"{Brackets.columns}, name string"

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        name = None
        for pos, tag, form in super().rows(lines):
            name = form if pos == 0 else name
            yield pos, tag, form, name


class Examples(RecordSource):
    """Integers `labels | features` on each line; what is no integer is left out."""

    kind, blocks, columns = "examples", False, "labels array<int>, features array<int>"

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        yield tuple([int(x) for x in part.split() if x.lstrip("-").isdigit()] for part in (lines[0].split("|") + [""])[:2])


def register(spark: SparkSession, *more: type[RecordSource]) -> None:
    """Makes the formats of this module, and those given, known to the session by their names."""
    for source in (Columns, Brackets, NamedBrackets, Examples, *more):
        spark.dataSource.register(source)
