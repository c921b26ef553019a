"""Files of many pages, one portable any-map after the other, as a Spark data source.

    spark.dataSource.register(PageSource)
    spark.read.format("linework_pages").option("split_bytes", 64 << 20).load(folder)

A file is planned as ranges of bytes. A page belongs to the range that it begins in, so a file of any size splits over tasks; a
task hops from header to header to its first page, reading no pixels on its way. Many small files are no task each: with
task_bytes a task takes ranges one after the other up to so many bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from linework.schemas import PAGES
from linework.sources.pages import _HEADER, PageError
from linework.storage import filesystem

#: Bytes of a file that one task reads, and of pages that it hands on at once.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
HEADER_BYTES = 1024
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = ["page_id", "page_no", "height", "width", "channels", "pixels"]


@dataclass
class PageRange(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class PageRanges(InputPartition):
    ranges: list[PageRange]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.strict = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.split, self.pixels = int(options.get("split_bytes", SPLIT_BYTES)), options.get("pixels", "true").lower() == "true"
        self.task = int(options.get("task_bytes", 0))

    def partitions(self) -> list[PageRanges]:
        files, path = filesystem(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path))
        found = sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        ranges = [PageRange(x.path, at, min(at + self.split, x.size)) for x in found for at in range(0, x.size, self.split)]
        tasks: list[PageRanges] = []
        room = 0
        for part in ranges:
            size = part.stop - part.start
            if not tasks or size > room:
                tasks.append(PageRanges([]))
                room = max(self.task, size)
            tasks[-1].ranges.append(part)
            room -= size
        return tasks

    def read(self, partition: PageRanges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        files, _ = filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        for part in partition.ranges:
            with files.open_input_file(part.path) as f:
                for row in self._pages(f, part):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    def _pages(self, f: pa.NativeFile, part: PageRange) -> Iterator[tuple]:
        at = page = 0
        end = f.size()
        while at < min(part.stop, end):
            page += 1
            label, mine = f"{part.path} [page {page}]", at >= part.start
            f.seek(at)
            head = _HEADER.match(f.read(HEADER_BYTES))
            wrong = "no binary portable any-map" if not head or head[1] not in (b"P5", b"P6") else ""
            if not wrong:
                width, height, top, depth = int(head[2]), int(head[3]), int(head[4]), 3 if head[1] == b"P6" else 1
                first, n = at + head.end(), width * height * depth * (1 if top < 256 else 2)
                wrong = "file is cut off" if first + n > end else ""
            if wrong:  # where the next page begins can't be told
                if mine and self.strict:
                    raise PageError(f"{label}: {wrong}")
                if mine:
                    yield label, page, 0, 0, 0, None
                return
            if mine:
                yield label, page, height, width, depth, self._decoded(f, first, n, top, depth) if self.pixels else None
            at = first + n

    def _decoded(self, f: pa.NativeFile, first: int, n: int, top: int, depth: int) -> bytes:
        f.seek(first)
        raw = f.read(n)
        if top == 255 and depth == 1:
            return raw
        values = np.frombuffer(raw, np.uint8 if top < 256 else ">u2")
        if top != 255:
            values = (values.astype(np.int64) * 255 // top).astype(np.uint8)
        return values.reshape(-1, depth)[:, ::-1].tobytes()  # three channels are blue, green, red


class PageSource(DataSource):
    """Options: path; split_bytes; task_bytes (0: a task for each range); mode (FAILFAST raises at a page that can't be read, else it is a row of null pixels); pixels (false: sizes alone)."""

    @classmethod
    def name(cls) -> str:
        return "linework_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options))


def paged_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Pages of a file or of a folder's files, labelled 'path [page n]' and numbered from 1."""
    spark.dataSource.register(PageSource)
    return spark.read.format("linework_pages").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)
