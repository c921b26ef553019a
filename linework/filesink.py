"""A file for each row, written by executors: a Spark data source for rows (name, content).

    spark.dataSource.register(FileSink)
    rows.write.format("linework_files").mode("overwrite").save(folder)

A task writes its files under a temporary folder and lists them there; the driver is sent one line for a task. Files get their
names when all tasks have ended well, by threads that work list by list, so a job that fails leaves none, nor do tasks that run on
after it failed. With the option lists, a folder, the tasks' lists of names stay there: listed_files() reads files back by them, so
that the driver neither lists the folder nor holds a name of each file.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linework.storage import filesystem

TEMPORARY, LIST = "_temporary", "list"
#: Threads that give files their names.
THREADS = 16
#: Most rows and bytes of an Arrow batch while files are made and written: a worker holds a batch's files as Python objects, several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 128, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def moved(files: fs.FileSystem, temporary: str, path: str) -> str:
    """Moves a whole file to its path; where that can't be written, to one with the time in its name."""
    try:
        files.move(temporary, path)
        return path
    except PermissionError:
        stem, ext = posixpath.splitext(path)
        other = f"{stem}_{time.strftime('%Y%m%d_%H%M%S')}{ext}"
        files.move(temporary, other)
        return other


def save_file(content: bytes, path: str) -> str:
    """Writes a file whole: under another name first, then moved(). Gives its path."""
    path = os.path.abspath(path)
    files, temporary = fs.LocalFileSystem(), f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    files.create_dir(os.path.dirname(path))
    with files.open_output_stream(temporary) as f:
        f.write(content)
    return moved(files, temporary, path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, lists: str | None = None):
        self.path, self.lists, self.job = path, lists, uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        files, root = filesystem(self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._root()
        mine = f"{root}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}"
        places: list[str] = []
        files.create_dir(mine)
        for k, row in enumerate(iterator):
            name = posixpath.normpath(row["name"] or "")
            if name in ("", ".") or name.startswith(("/", "..", TEMPORARY)):
                raise ValueError(f"no name of a file in the folder: {row['name']!r}")
            with files.open_output_stream(f"{mine}/{k}") as f:
                f.write(bytes(row["content"] or b""))
            places.append(name)
        with files.open_output_stream(f"{mine}/{LIST}") as f:
            f.write(json.dumps(places).encode())
        return Written(mine, len(places))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._root()
        files.create_dir(root)
        lists = filesystem(self.lists)[1] if self.lists else None
        if lists:
            files.create_dir(lists)

        def place(message: Written) -> None:
            with files.open_input_stream(f"{message.folder}/{LIST}") as f:
                names = json.loads(f.read())
            for folder in {posixpath.dirname(n) for n in names} - {""}:
                files.create_dir(f"{root}/{folder}")
            for k, name in enumerate(names):
                moved(files, f"{message.folder}/{k}", f"{root}/{name}")
            if lists:
                files.move(f"{message.folder}/{LIST}", f"{lists}/{posixpath.basename(message.folder)}")

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(place, [m for m in messages if m]))
        self._cleared(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*self._root())

    def _cleared(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{TEMPORARY}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{TEMPORARY}")


class FileSink(DataSource):
    """Options: path, the folder; lists, a folder of the same store for the lists of names. Mode overwrite empties it first, as Spark's own writers do; append adds to it, files of a name replaced."""

    @classmethod
    def name(cls) -> str:
        return "linework_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        path, lists = self.options["path"], self.options.get("lists")
        for folder in (path, lists) if overwrite else ():
            if not folder:
                continue
            files, root = filesystem(folder)
            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)
        return FileWriter(path, lists)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, most in BATCHES.items():
            own = int(before[k]) if before[k] and before[k].isdigit() else 0
            spark.conf.set(k, str(min(own, most) if own > 0 else most))
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def save_files(rows: DataFrame, path: str, mode: str = "overwrite", lists: str | None = None) -> None:
    """Each row's content (binary, null: empty) as the file of its name in a folder; names may have folders of their own.

    While files are written, and their content is made, Arrow batches keep within BATCHES; the session's own settings come back after.
    lists names a folder where listed_files() finds what was written.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    with small_batches(spark):
        rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("linework_files").options(**{"lists": lists} if lists else {}).mode(mode).save(path)


def listed_files(spark: SparkSession, path: str, lists: str) -> DataFrame:
    """(name, content) of the files that save_files() wrote to a folder with these lists. The driver knows one list a writing task."""
    files, root = filesystem(lists)
    found = [(x.path,) for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File]
    kind = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(lists)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                with store.open_input_stream(one) as f:
                    yield pa.RecordBatch.from_arrays([pa.array(json.loads(f.read()), pa.string())], ["name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        rows: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
                    rows.append((name, f.read()))
                size += len(rows[-1][1])
                if size > BATCHES["spark.sql.execution.arrow.maxBytesPerBatch"]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    # Names are few bytes but much work: a set number of partitions keeps adaptive execution from merging them into one.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    listing = spark.createDataFrame(found, "list string").repartition(max(1, min(n, len(found))))
    # An appended file may take the name of an older one.
    names = listing.mapInArrow(named, "name string").repartition(n, "name").dropDuplicates(["name"])
    return names.mapInArrow(read, "name string, content binary")
