"""The log folder as a data source: `spark.read.format("mutation_log")`, batch and stream.

A place in the log is a file and a byte. Tasks read byte ranges of files, and a record
belongs to the range it begins in, so the order of equal times is exact however the files
are cut: nothing is numbered by the order in which Spark happens to read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.readwriter import DataStreamReader

from cellshift.sources.mutation_log import FILE_COLUMNS, parse_log

# The functions of this module run in tasks, where the package may not be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "mutation_log"
SCHEMA = "value string, file_time timestamp, file_path string, file_block bigint, seq bigint"
BLOCK_BYTES = 128 << 20
# A task costs a Python worker some tenths of a second whatever it reads, so smaller ranges grow
# with the log: up to BLOCK_BYTES there are about so many, beyond that one for each BLOCK_BYTES.
RANGES = 200
# `seq` holds the file's number above the byte; what does not fit is refused.
BYTE_BITS, FILE_BITS = 43, 20

# What lies between two records: a line break, or one between the brackets of two records.
_LINE = re.compile(rb"\r\n|\r|\n")
_RECORD = re.compile(rb"(?<=\])\n(?=\[)")
_MARK = b"\x1b"
_READ_BYTES, _BATCH_ROWS = 4 << 20, 50_000
# Read at a time beyond the end of a range, where its last record ends.
_TAIL_BYTES = 64 << 10


@dataclass
class ByteRange(InputPartition):
    path: str
    time: datetime
    nth: int | None
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Local paths with or without `file:`, and the schemes that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[fs.FileInfo]:
    """The files right in the folder, or the one file; hidden ones are left out."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
    return [f for f in found if f.is_file and f.size and f.base_name[0] not in "._"]


def _starts(read, size: int, start: int, between: re.Pattern) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, byte after, record) of the records from the first one that begins at
    `start` or later; `read(at, n)` gives n bytes of the file.

    Bytes are held from where the record at hand begins. A record of many reads is searched
    once, not again from its beginning with each read.
    """
    at = max(start - 2, 0)  # a break may lie across the border
    held, base, searched, inside = bytearray(), at, 0, start == 0
    while True:
        more = read(at, min(_READ_BYTES, size - at))
        at += len(more)
        held += more
        done = at >= size or not more
        first = 0
        for m in between.finditer(held, searched):
            if m.end() == len(held) and not done:
                break  # the next byte may belong to the break
            if inside:
                yield base + first, base + m.end(), bytes(held[first:m.start()])
            # The first break at the border or behind it begins the first record.
            inside = inside or base + m.end() >= start
            first = m.end()
        if done:
            if inside and first < len(held):
                yield base + first, base + len(held), bytes(held[first:])
            return
        del held[:first]
        base += first
        searched = max(len(held) - 2, 0)


class _Ranges:
    """What the batch and the stream reader share; goes to the tasks."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.records = options.get("records", "false").lower() == "true"
        self.escaped = options.get("escaped", "false").lower() == "true"
        self.block = int(options.get("blockBytes", BLOCK_BYTES))
        self.between = _RECORD if self.records or self.escaped else _LINE

    def cut(self, parts: list[tuple[fs.FileInfo, int | None, int, int]]) -> list[ByteRange]:
        """The ranges of (file, its number, first byte, byte after)."""
        total = sum(end - start for _, _, start, end in parts)
        size = max(self.block, min(BLOCK_BYTES, -(-total // RANGES)))
        return [
            ByteRange(self.url(file), file.mtime.astimezone(timezone.utc), nth, at, min(at + size, end))
            for file, nth, start, end in parts
            for at in range(start, end, size)
        ]

    def url(self, file: fs.FileInfo) -> str:
        if "://" not in self.path or self.path.startswith("file:"):
            return file.path
        return self.path[: self.path.rindex(_open(self.path)[1])] + file.path

    def value(self, record: bytes) -> str:
        if self.between is _RECORD:
            # As in `log_records`: what is no record gets brackets and is rejected later.
            first, last = record.startswith(b"["), record.endswith(b"]\n")
            inner = record[int(first): len(record) - (2 if last else int(record.endswith(b"]")))]
            if self.escaped:
                inner = inner.replace(b"\n" + _MARK, b"\n")
            record = b"[" + inner + b"]"
        return record.decode("utf-8", "replace")

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        system, inner = _open(part.path)
        values, places = [], []
        with system.open_input_file(inner) as source:

            def read(at: int, n: int) -> bytes:
                return source.read_at(min(n, max(part.end - at, _TAIL_BYTES)), at)

            for first, _, record in _starts(read, source.size(), part.start, self.between):
                if first >= part.end:
                    break
                values.append(self.value(record))
                places.append(first)
                if len(values) == _BATCH_ROWS:
                    yield _batch(part, values, places)
                    values, places = [], []
        if values:
            yield _batch(part, values, places)


def _batch(part: ByteRange, values: list[str], places: list[int]) -> pa.RecordBatch:
    n = len(values)
    seq = [None if part.nth is None else (part.nth << BYTE_BITS) | p for p in places]
    return pa.record_batch(
        [
            pa.array(values, pa.string()),
            pa.array([part.time] * n, pa.timestamp("us", "UTC")),
            pa.array([part.path] * n, pa.string()),
            pa.array(places, pa.int64()),
            pa.array(seq, pa.int64()),
        ],
        names=["value", *FILE_COLUMNS, "seq"],
    )


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        files = sorted(_files(self.path), key=lambda f: (f.mtime_ns, f.path))
        if len(files) >> FILE_BITS or any(f.size >> BYTE_BITS for f in files):
            raise ValueError(f"over {1 << FILE_BITS} files, or one of over {1 << BYTE_BITS} bytes: {self.path}")
        ranges = self.cut([(f, nth, 0, f.size) for nth, f in enumerate(files)])
        return ranges or [ByteRange("", datetime.now(timezone.utc), None, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.path else iter(())


class _Stream(_Ranges, DataSourceStreamReader):
    """Reads segments in the order of their names; the last one may grow, by whole records.

    An offset is the last segment, the byte in it, and how many segments there are up to it.
    Old segments may be removed. One that turns up among those already read would be lost,
    so it ends the query with an error.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.seen = {"path": "", "byte": 0, "files": 0}

    def initialOffset(self) -> dict:
        return {"path": "", "byte": 0, "files": 0}

    def latestOffset(self) -> dict:
        files = sorted(_files(self.path), key=lambda f: f.path)
        if not files:
            return self.seen
        last = files[-1]
        self.seen = {"path": last.path, "byte": self.whole(last), "files": len(files)}
        return self.seen

    def whole(self, file: fs.FileInfo) -> int:
        """The end of the last whole record, looked for from the end of the file."""
        system, _ = _open(self.path)
        ending = b"]\n" if self.between is _RECORD else b"\n"
        with system.open_input_file(file.path) as source:
            end, tail = file.size, b""
            while end:
                begin = max(end - _READ_BYTES, 0)
                tail = source.read_at(end - begin, begin) + tail[: len(ending)]
                found = tail.rfind(ending)
                if found >= 0:
                    return begin + found + len(ending)
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        files = sorted(_files(self.path), key=lambda f: f.path)
        before = sum(f.path <= start["path"] for f in files)
        if before > start["files"]:
            raise ValueError(f"a segment turned up among those already read, up to {start['path']}")
        parts = []
        for f in files[max(before - 1, 0):]:
            if start["path"] <= f.path <= end["path"]:
                begin = start["byte"] if f.path == start["path"] else 0
                parts.append((f, None, begin, end["byte"] if f.path == end["path"] else f.size))
        return self.cut(parts)

    def commit(self, end: dict) -> None:
        pass


class MutationLog(DataSource):
    """Options: `path`; `records` when values may hold line breaks; `escaped` when they were
    written with marks; `blockBytes`, the least size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register_log_source(spark: SparkSession) -> None:
    spark.dataSource.register(MutationLog)


def log_source(reader: DataFrameReader | DataStreamReader, path: str, escaped: bool | None = None,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines and their places by the data source, for `parse_log` and `split_log`.

    `escaped` is that of `read_log`. A batch has `seq`, by the files' times, paths and bytes; a
    stream has the columns of `log_lines`, whose block is then the byte. The executors open
    the files themselves, so the path must be one that they see: a shared folder, or a
    store that Arrow has a file system for.
    """
    reader = reader.format(FORMAT).option("blockBytes", block_bytes)
    if escaped is not None:
        reader = reader.option("records", True).option("escaped", escaped)
    lines = reader.load(path)
    return lines.drop("seq") if lines.isStreaming else lines.drop(*FILE_COLUMNS)


def load_log(spark: SparkSession, path: str, is_super: bool = False, escaped: bool | None = None,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As `read_log`, by the data source: ties are ordered by file and byte, without a join."""
    register_log_source(spark)
    return parse_log(log_source(spark.read, path, escaped, block_bytes), is_super)
