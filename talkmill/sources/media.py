"""Media folders as a data source: names, sizes and the first bytes of every file.

Spark's binary file source reads a file whole to show any of it and leaves out files of zero
bytes.  This one opens each file for its first bytes only.  The driver lists the upper
folders; the rest of the tree is listed by the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Enough to tell a container.
HEAD_BYTES = 12
#: Folders among which the files are shared out, about.
FOLDERS = 256
ROWS_PER_BATCH = 4096


def local_path(path: str) -> str:
    """A path that tasks open as a file: a local or mounted folder, also as a ``file:`` URI."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else path
    raise ValueError(f"not a folder that tasks can open: {path}")


@dataclass
class Folder(InputPartition):
    """A folder, with all below it or only its own files."""

    path: str
    whole: bool


class MediaFolder(DataSource):
    """``path``, ``length``, ``modified`` and ``head`` of all files below option ``path``.

    Option ``head`` is how many bytes are read of each file (12; 0 opens none), ``suffixes``
    a comma-separated list of the suffixes to list, lower case, all if absent.  A file that
    can't be opened has a null head.  Links are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _MediaReader(self.options)


class _MediaReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = local_path(options["path"])
        self.head = int(options.get("head", HEAD_BYTES))
        names = options.get("suffixes")
        self.suffixes = None if names is None else tuple(names.lower().split(","))

    def partitions(self) -> list[Folder]:
        """Open folders from the top until there are enough, or no more."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        done, level = [], [self.root]
        while level and len(level) + len(done) < FOLDERS:
            below = []
            for folder in level:
                with os.scandir(folder) as entries:
                    below += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
                done.append(Folder(folder, False))
            level = below
        return done + [Folder(folder, True) for folder in level]

    def _files(self, folder: str, whole: bool) -> Iterator[os.DirEntry]:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_file(follow_symlinks=False):
                    if self.suffixes is None or entry.name.lower().endswith(self.suffixes):
                        yield entry
                elif whole and entry.is_dir(follow_symlinks=False):
                    yield from self._files(entry.path, whole)

    def _row(self, entry: os.DirEntry) -> tuple:
        facts, head = entry.stat(follow_symlinks=False), None
        if self.head:
            try:
                with open(entry.path, "rb") as file:
                    head = file.read(self.head)
            except OSError:
                pass
        return (entry.path, facts.st_size,
                datetime.fromtimestamp(facts.st_mtime, timezone.utc), head)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()),
                            ("modified", pa.timestamp("us", "UTC")), ("head", pa.binary())])
        rows: list[tuple] = []
        for entry in self._files(partition.path, partition.whole):
            rows.append(self._row(entry))
            if len(rows) == ROWS_PER_BATCH:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def media_files(spark: SparkSession, root: str, head: int = HEAD_BYTES,
                suffixes: list[str] | None = None) -> DataFrame:
    """The files below a folder, see :class:`MediaFolder`."""
    spark.dataSource.register(MediaFolder)
    reader = spark.read.format("media_folder").option("head", head)
    if suffixes is not None:
        reader = reader.option("suffixes", ",".join(suffixes))
    return reader.load(root)


def write_media(files: DataFrame, root: str) -> None:
    """Write files from rows of ``path`` (below ``root``) and ``content``, one each.

    A file appears whole under its name or not at all, so a task may run again.
    """
    top = local_path(root)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = 0
        for part in parts:
            for path, content in zip(part.column(0), part.column(1), strict=True):
                target = os.path.join(top, path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                scratch = f"{target}.{os.getpid()}.part"
                with open(scratch, "wb") as file:
                    file.write(content.as_py() or b"")
                os.replace(scratch, target)
                many += 1
        yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64())], ["many"])

    os.makedirs(top, exist_ok=True)
    files.select("path", "content").mapInArrow(run, "many bigint").write.format("noop").mode(
        "overwrite").save()
