"""Paged files as a partitioned Python data source.

``spark.read.format("paged_files").option("path", folder).load()`` gives a row per
page: ``path, begin, text, error``. Pages are separated by a form feed (option
``separator``, one byte). Files are read in byte ranges (``range_bytes``): a range
owns the pages that begin in it, finds the first of them itself, and its reader
goes on to the end of its last one. A partition is a range, or several where there
are more than ``TASKS`` and they hold few bytes, so many small files need few tasks. Bytes are read in small
pieces and a page is handed on as soon as it is whole, so a file of any size is
read by many tasks and only a page has to fit in memory.

``begin`` is the page's byte offset and orders the pages of a file; ``read_pages``
adds dense page numbers without gathering a file in one task. A file that ends with
a separator has an empty last page; an empty file has one empty page; a page that is
not UTF-8 has no text and an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusflow.functions.sequence import seq_within
from corpusflow.session import ship_package
from corpusflow.sources.batches import _open

FORMAT = "paged_files"
SCHEMA = "path string, begin long, text string, error string"
RANGE_BYTES = 64 << 20
#: Ranges share tasks where there are more of them, as far as a task has at most about ``RANGE_BYTES``.
TASKS = 256
#: Bytes read at once.
PIECE = 1 << 20


@dataclass
class ByteRanges(InputPartition):
    """``path, start, end`` of ranges that one task reads, one after the other."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def page_bytes(source, start: int, end: int, separator: bytes, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """``begin, bytes`` of the pages that begin in ``[start, end)`` of a seekable file."""
    # a page begins at 0 and after every separator: one byte earlier may be that separator
    source.seek(max(0, start - 1))
    at = max(0, start - 1)
    begin = 0 if start == 0 else None
    held: list[bytes] = []
    while True:
        data = source.read(piece)
        if not data:
            break
        place = 0
        while place < len(data):
            if begin is not None and not held and begin >= end:
                return
            cut = data.find(separator, place)
            if begin is not None:
                held.append(data[place:cut if cut >= 0 else len(data)])
            if cut < 0:
                break
            if begin is not None:
                yield begin, b"".join(held)
            held, begin, place = [], at + cut + 1, cut + 1
        at += len(data)
    if begin is not None and begin < end:
        yield begin, b"".join(held)


class PagedReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, separator: str):
        self.path, self.range_bytes, self.separator = path, range_bytes, separator.encode()
        if len(self.separator) != 1 or range_bytes < 1:
            raise ValueError("the separator is one byte, and ranges have bytes")

    def partitions(self) -> list[ByteRanges]:
        from pyarrow import fs

        files, base = _open(self.path)
        info = files.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            starts = list(range(0, f.size, self.range_bytes)) or [0]
            # the last range owns a page that begins at the very end
            out += [(f.path, a, min(a + self.range_bytes, f.size) if a != starts[-1] else f.size + 1) for a in starts]
        tasks = max(TASKS, -(-sum(end - start for _, start, end in out) // RANGE_BYTES))
        each = max(1, -(-len(out) // tasks))
        return [ByteRanges(out[k:k + each]) for k in range(0, len(out), each)]

    def read(self, part: ByteRanges | None) -> Iterator[tuple]:
        if part is None:  # how Spark asks where there are no partitions
            return
        files, _ = _open(self.path)
        for path, start, end in part.ranges:
            with files.open_input_file(path) as source:
                for begin, data in page_bytes(source, start, end, self.separator):
                    try:
                        yield path, begin, data.decode(), None
                    except UnicodeDecodeError as e:
                        yield path, begin, None, f"page at {begin}: {e.reason}"


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("separator", "\f"))


def read_pages(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, separator: str = "\f") -> DataFrame:
    """``path, page_no, text, error`` of every page below ``path``; pages of a file are numbered from 0."""
    ship_package(spark)
    spark.dataSource.register(PagedFiles)
    pages = spark.read.format(FORMAT).option("path", path).option("range_bytes", str(range_bytes)).option("separator", separator).load()
    return seq_within(pages, "path", ["begin"], "page_no").select("path", F.col("page_no"), "text", "error")
