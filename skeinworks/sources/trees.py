"""`source_tree`: folders of source files as a Spark data source, read, streamed and written.

    spark.read.format("source_tree").option("path", root).load().where("path LIKE 'lib/%'")

Rows are (path, content, size, modified), path relative to the root. Filters on `path` are pushed
into the listing: a prefix or an exact path keeps folders from being listed at all. Files are
planned into partitions of bounded bytes, so many small ones share a task; only names and sizes
are known to the driver. As a stream, a batch holds the files modified since the last one,
by their time; one that is written again is read again. Written rows become files.

Options: path; suffixes (comma-separated), split_bytes, settle_seconds (how old a file has to be
before a stream takes it, so that none of the same moment is missed).
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from skeinworks.session import reach_workers
from skeinworks.sources.files import SKIPPED, SUFFIXES

NAME, SCHEMA = "source_tree", "path string, content string, size long, modified timestamp"
#: Bytes of files in a partition, and what opening one costs in bytes.
SPLIT_BYTES, OPEN_BYTES = 8 << 20, 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the root in it."""
    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, root.rstrip("/")


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files


class _Tree:
    """What the options say, and the files that they and the pushed filters leave."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.suffixes = tuple("." + s.strip() for s in options.get("suffixes", ",".join(SUFFIXES)).split(","))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.settle = float(options.get("settle_seconds", 1))
        self.filters: list[Filter] = []

    def fits(self, path: str) -> bool:
        return path.endswith(self.suffixes) and all(_holds(f, path) for f in self.filters)

    def listed(self) -> Iterator[tuple[str, int, int]]:
        """path, size and time (ns) of the files, folder by folder."""
        store, root = opened(self.path)
        waiting = [root]
        while waiting:
            for info in store.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
                path = info.path[len(root) + 1 :]
                if info.type == fs.FileType.Directory:
                    if info.base_name not in SKIPPED and all(_may_hold(f, path + "/") for f in self.filters):
                        waiting.append(info.path)
                elif info.type == fs.FileType.File and self.fits(path):
                    yield path, info.size, info.mtime_ns or 0

    def planned(self, files: list[tuple[str, int, int]]) -> list[Files]:
        parts, now, size = [], [], 0
        for f in sorted(files):
            if now and size + f[1] + OPEN_BYTES > self.split:
                parts.append(Files(now))
                now, size = [], 0
            now.append(f)
            size += f[1] + OPEN_BYTES
        return [*parts, Files(now)] if now else parts

    def read(self, part: Files) -> Iterator[tuple]:
        store, root = opened(self.path)
        for path, size, modified in part.files:
            with store.open_input_stream(f"{root}/{path}") as file:
                text = file.read().decode(errors="replace")
            yield path, text, size, datetime.datetime.fromtimestamp(modified / 1e9, datetime.UTC)


def _holds(f: Filter, path: str) -> bool:
    if isinstance(f, EqualTo):
        return path == f.value
    if isinstance(f, In):
        return path in f.value
    test = {StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: path.__contains__}[type(f)]
    return test(f.value)


def _may_hold(f: Filter, folder: str) -> bool:
    """Whether a path in the folder could pass."""
    if isinstance(f, EqualTo):
        return f.value.startswith(folder)
    if isinstance(f, In):
        return any(v.startswith(folder) for v in f.value)
    return not isinstance(f, StringStartsWith) or f.value.startswith(folder) or folder.startswith(f.value)


class _Reader(DataSourceReader):
    def __init__(self, tree: _Tree) -> None:
        self.tree = tree

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("path",):
                continue  # it never is
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains) and f.attribute == ("path",):
                self.tree.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        return self.tree.planned(list(self.tree.listed())) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are times of modification, in nanoseconds."""

    def __init__(self, tree: _Tree) -> None:
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.tree.settle * 1e9)
        return {"modified": max((m for _, _, m in self.tree.listed() if m <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.tree.planned([f for f in self.tree.listed() if start["modified"] < f[2] <= end["modified"]]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.tree.read(partition)


class _Writer(DataSourceWriter):
    """Each row with a content is a file of its path. A repeated task writes the same files."""

    def __init__(self, tree: _Tree) -> None:
        self.tree = tree

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = opened(self.tree.path)
        made: set[str] = set()
        for row in iterator:
            if row["path"] is None or row["content"] is None:
                continue
            at = f"{root}/{row['path']}"
            if (folder := at.rsplit("/", 1)[0]) not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(at) as file:
                file.write(row["content"].encode())
        return WriterCommitMessage()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Tree(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Tree(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added to a tree, or written again; use append")
        return _Writer(_Tree(self.options))


def register(spark: SparkSession) -> None:
    """Make `source_tree` known to the session, and let filters reach it."""
    reach_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
