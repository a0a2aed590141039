"""A data source that lists evidence folders completely.

Spark's own file sources hide names that begin with a dot or an underscore, and
folders without files; a package check must see both.  `evidence_listing` reads
the names below a root once, on the driver, and hands them to tasks in runs; a
task walks its folders one directory at a time, so its memory holds one
directory, and yields a row for each entry.  Local paths are walked with the
operating system, which also tells links from files; other locations with the
file system that Arrow has for their scheme.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from gaugework.session import materialize

SOURCE = "evidence_listing"
SCHEMA = "folder string, file string, kind string, length long, path string"
# Names of one task, and rows of one batch.
FOLDERS_PER_TASK = 200
BATCH_ROWS = 4096
BATCH_BYTES = 32 << 20

Entry = tuple[str, str, int | None]  # name, kind, length


class _Local:
    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_symlink():
                    yield entry.name, "link", None
                elif entry.is_dir():
                    yield entry.name, "folder", None
                elif entry.is_file():
                    yield entry.name, "file", entry.stat().st_size
                else:
                    yield entry.name, "other", None


class _Arrow:
    KINDS = {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}

    def __init__(self, root: str):
        self._files, self._base = pafs.FileSystem.from_uri(root)
        self._root = root

    def entries(self, folder: str) -> Iterator[Entry]:
        inside = self._base.rstrip("/") + folder.removeprefix(self._root)
        for info in self._files.get_file_info(pafs.FileSelector(inside)):
            kind = self.KINDS.get(info.type, "other")
            yield info.base_name, kind, info.size if kind == "file" else None


def _walker(root: str):
    """The walker of a root, and the root as that walker spells it."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    root = root.rstrip("/") or "/"
    return (_Local(), root) if root.startswith("/") else (_Arrow(root), root)


@dataclass
class _Run(InputPartition):
    entries: list[Entry]


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self._root, self._per_task = root, per_task

    def partitions(self) -> list[_Run]:
        walker, root = _walker(self._root)
        top = sorted(walker.entries(root), key=lambda e: e[0])
        runs = [_Run(top[i : i + self._per_task]) for i in range(0, len(top), self._per_task)]
        return runs or [_Run([])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _rows(self, partition: _Run) -> Iterator[tuple]:
        walker, root = _walker(self._root)
        for name, kind, length in partition.entries:
            path = f"{root}/{name}"
            if kind != "folder":
                yield None, name, kind, length, path
                continue
            waiting = [""]  # the package and folders below it, as they are met
            while waiting:
                below = waiting.pop()
                inside = f"{path}/{below}".rstrip("/")
                empty = True
                for inner, inner_kind, size in walker.entries(inside):
                    empty = False
                    if inner_kind == "folder":
                        waiting.append(f"{below}{inner}/")
                    else:
                        yield name, f"{below}{inner}", inner_kind, size, f"{path}/{below}{inner}"
                yield name, below.rstrip("/") or None, "empty" if empty else "folder", None, inside


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")]
    )


class EvidenceListing(DataSource):
    """Options: path, and foldersPerTask."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("foldersPerTask", FOLDERS_PER_TASK)))


def read_bytes(
    entries: DataFrame, keys: list[str], paths: dict[str, str], missing_as_null: bool = False
) -> DataFrame:
    """Adds the bytes of files: `paths` maps new columns to path columns (null: null).

    A file that is not there fails the job, or is null with `missing_as_null`.

    Tasks open the files themselves, so bytes are not shuffled; a batch ends
    after BATCH_BYTES.
    """
    rows = entries.select(*keys, *paths.values())
    out = StructType([*entries.select(*keys).schema.fields, *[StructField(c, BinaryType()) for c in paths]])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            read: list[list[bytes | None]] = [[] for _ in paths]
            for row in range(batch.num_rows):
                for column, values in enumerate(read, width):
                    path = batch.column(column)[row].as_py()
                    values.append(None if path is None else _content(path, missing_as_null))
                    size += len(values[-1] or b"")
                if size >= BATCH_BYTES or row == batch.num_rows - 1:
                    kept = [batch.column(i).slice(start, row + 1 - start) for i in range(width)]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, pa.binary()) for v in read]], out.names)
                    start, size, read = row + 1, 0, [[] for _ in paths]

    return rows.mapInArrow(run, out)


def _content(path: str, missing_as_null: bool) -> bytes | None:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    try:
        if path.startswith("/"):
            with open(path, "rb") as file:
                return file.read()
        files, inside = pafs.FileSystem.from_uri(path)
        with files.open_input_stream(inside) as stream:
            return stream.read()
    except FileNotFoundError:
        if missing_as_null:
            return None
        raise


def list_entries(spark: SparkSession, root: str, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """Everything below `root`, hidden names and empty folders included, listed once and kept.

    `folder` is the first part of the path below the root, null for an entry
    that is no folder itself; `file` is the rest, null for the folder's own row.
    `kind` is file, folder, empty (a folder), link or other; links are not followed.
    """
    spark.dataSource.register(EvidenceListing)
    listed = spark.read.format(SOURCE).option("foldersPerTask", folders_per_task)
    return materialize(listed.load(root))
