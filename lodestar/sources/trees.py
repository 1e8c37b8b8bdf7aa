"""Directory trees as a Python data source: planned by directory, excluded directories never opened, links never followed.

    spark.dataSource.register(TreeSource)
    spark.read.format("lodestar_tree").option("content", "true").load("file:///shared/repository")

The driver opens directories level by level until there are enough for the wanted partitions; a partition then walks its
directories on an executor. What stands below an excluded name (functions/paths.py) is neither listed nor read.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.paths import EXCLUDED_DIRECTORIES

#: Directories that a plan aims at, for each partition; rows and bytes of a batch.
WANTED, ROWS, BYTES = 64, 1000, 8 << 20
SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])


class Entry(NamedTuple):
    name: str
    kind: str  # file, directory, other
    bytes: int


class Store:
    """Lists and reads below a root: a local folder by the operating system, anything else by pyarrow."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root or root.startswith("file:")
        if self.local:
            self.root = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
            self.root = self.root.rstrip("/") or "/"
        else:
            self.fs, self.root = pa.fs.FileSystem.from_uri(root)

    def at(self, relative: str) -> str:
        return f"{self.root}/{relative}" if relative else self.root

    def entries(self, relative: str) -> list[Entry]:
        """What a directory holds, by name; links are `other`."""
        if self.local:
            out = []
            with os.scandir(self.at(relative)) as found:
                for e in found:
                    info = e.stat(follow_symlinks=False)
                    kind = "directory" if stat.S_ISDIR(info.st_mode) else "file" if stat.S_ISREG(info.st_mode) else "other"
                    out.append(Entry(e.name, kind, info.st_size))
            return sorted(out)
        kinds = {pa.fs.FileType.File: "file", pa.fs.FileType.Directory: "directory"}
        return sorted(Entry(i.base_name, kinds.get(i.type, "other"), i.size or 0) for i in self.fs.get_file_info(pa.fs.FileSelector(self.at(relative))))

    def read(self, relative: str) -> bytes:
        if self.local:
            with open(self.at(relative), "rb") as f:
                return f.read()
        with self.fs.open_input_stream(self.at(relative)) as f:
            return f.read()


def below(parent: str, name: str) -> str:
    return f"{parent}/{name}" if parent else name


def opened(entry: Entry) -> bool:
    return entry.kind == "directory" and entry.name.lower() not in EXCLUDED_DIRECTORIES


@dataclass
class Directories(InputPartition):
    """Directories of a partition; `deep` ones with all that is below, the others only with their own files."""

    deep: tuple[str, ...]
    flat: tuple[str, ...]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a tree needs a path")
        self.root, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.directories, self.wanted = options.get("directories", "false").lower() == "true", max(1, int(options.get("partitions", WANTED)))

    def partitions(self) -> list[InputPartition]:
        """Levels are opened until one has enough directories: those above are flat, its own are deep."""
        store, level, flat = Store(self.root), [""], []
        while level and len(level) < self.wanted:
            lower = []
            for d in level:
                try:
                    lower += [below(d, e.name) for e in store.entries(d) if opened(e)]
                except OSError:
                    if not d:
                        raise  # the root itself cannot be read
            flat += level
            level = lower
        n = max(1, min(self.wanted, len(level) + len(flat)))
        return [Directories(tuple(level[i::n]), tuple(flat[i::n])) for i in range(n)]

    def rows(self, part: Directories) -> Iterator[tuple]:
        store = Store(self.root)
        todo = [(d, False) for d in part.flat] + [(d, True) for d in part.deep]
        while todo:
            at, deep = todo.pop()
            try:
                entries = store.entries(at)
            except OSError as e:
                yield at, "directory", None, None, str(e)
                continue
            if self.directories:
                yield at, "directory", None, None, None
            for e in entries:
                path = below(at, e.name)
                if e.kind == "file":
                    try:
                        yield path, "file", e.bytes, store.read(path) if self.content else None, None
                    except OSError as problem:
                        yield path, "file", e.bytes, None, str(problem)
                elif deep and opened(e):
                    todo.append((path, True))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(partition):
            held.append(row)
            size += len(row[3] or b"")
            if len(held) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class TreeSource(DataSource):
    """path, kind (file, or directory where asked for), bytes, content (where asked for), problem (what could not be read).

    Options: path; content (false); directories (false: rows for the directories opened, too); partitions (64).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_tree"

    def schema(self) -> str:
        return "path string, kind string, bytes bigint, content binary, problem string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, content: bool = False, directories: bool = False, partitions: int = WANTED) -> DataFrame:
    """The tree below `root`, a path or URI that the driver and all executors reach."""
    spark.dataSource.register(TreeSource)
    options = {"content": str(content).lower(), "directories": str(directories).lower(), "partitions": str(partitions)}
    return spark.read.format("lodestar_tree").options(**options).load(root)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes each file (path, content) below `root`, a folder that all executors share; (path, bytes) of what was written.

    Nothing is written before the result is read. A repeated task writes the same files again.
    """
    local = Store(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (content or "").encode()
                where = local.at(path)
                if local.local:
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    with open(f"{where}.{os.getpid()}.part", "wb") as f:
                        f.write(raw)
                    os.replace(f"{where}.{os.getpid()}.part", where)
                else:
                    local.fs.create_dir(os.path.dirname(where), recursive=True)
                    with local.fs.open_output_stream(where) as f:
                        f.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
