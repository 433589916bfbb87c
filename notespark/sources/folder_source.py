"""A folder tree of notes as a Spark data source that is listed by tasks.

The driver lists directories of the upper levels only. Each of them is a partition, whose task walks what lies below and
hands on one row per file, so no process ever holds the list of all files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Tasks get these classes with the plan, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "note_folder"
FIELDS = ("path", "n_bytes", "modified", "content")
SCHEMA = "path string, n_bytes bigint, modified timestamp, content string"
# Rows and bytes of text that a task holds before it hands them on.
BATCH_FILES, BATCH_BYTES = 4096, 16 << 20


def _open(folder: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what is put before its paths to give those that Spark gives."""
    scheme = urlsplit(folder).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), (urlsplit(folder).path if scheme else folder).rstrip("/") or "/", "file:"
    system, inner = fs.FileSystem.from_uri(folder)
    at = folder.find(inner.strip("/")) if inner.strip("/") else len(folder)
    return system, inner.rstrip("/"), folder[:at] + ("" if inner.startswith("/") and folder[:at].endswith("/") else "")


def _hidden(name: str) -> bool:
    """Names that Spark passes over."""
    return name.startswith((".", "_"))


@dataclass
class Tree(InputPartition):
    """A directory with all that lies below, or just its own files."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.folder, self.levels = options["path"], int(options.get("levels", 2))
        self.suffix = options.get("suffix", "")

    def _listed(self, system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        below = [i for i in system.get_file_info(fs.FileSelector(folder)) if not _hidden(i.base_name)]
        return [i.path for i in below if i.type == fs.FileType.Directory], [i for i in below if i.type == fs.FileType.File]

    def partitions(self) -> list[Tree]:
        system, top, _ = _open(self.folder)
        trees, level = [], [top]
        for _ in range(self.levels):
            trees += [Tree(folder, False) for folder in level]
            level = [d for folder in level for d in self._listed(system, folder)[0]]
        return trees + [Tree(folder, True) for folder in level]

    def read(self, partition: Tree) -> Iterator[pa.RecordBatch]:
        system, _, head = _open(self.folder)
        waiting, rows, held = [partition.folder], [], 0
        kinds = {"path": pa.string(), "n_bytes": pa.int64(), "modified": pa.timestamp("us", "UTC"), "content": pa.string()}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(self.names, zip(*rows))], self.names)

        while waiting:
            folders, files = self._listed(system, waiting.pop())
            if partition.deep:
                waiting += folders
            for info in files:
                if not info.base_name.endswith(self.suffix):
                    continue
                at = info.mtime  # in milliseconds, as Spark has it
                at = at and at.replace(microsecond=at.microsecond // 1000 * 1000)
                row = {"path": head + info.path, "n_bytes": info.size, "modified": at}
                if "content" in self.names:
                    with system.open_input_stream(info.path) as stream:
                        row["content"] = stream.read().decode("utf-8", "replace")
                    held += info.size
                rows.append(tuple(row[n] for n in self.names))
                if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class FolderSource(DataSource):
    """Options: ``path``; ``levels`` of directories that the driver lists; ``suffix`` of the files wanted; ``content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA if self.options.get("content", "false") == "true" else SCHEMA.rsplit(",", 1)[0]

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(schema, dict(self.options))
