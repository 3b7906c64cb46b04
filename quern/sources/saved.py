"""Saved sources as a Spark data source [A2, A23]: ``spark.read.format("saved_source")``, and the same as a stream.

A partition is a file. Files are listed and opened through pyarrow's file systems (local,
HDFS, S3, ...), as a data source in Python has no access to Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import STORY, _feed, cards_in

NAMES = [c.split()[0] for c in STORY.split(", ")]


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _at(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before it again)."""
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)
        return system, path, root[: len(root) - len(path)] if root.endswith(path) else ""
    return fs.LocalFileSystem(), root, ""


def listed(root: str) -> list[tuple[int, str]]:
    """(time of the last change in nanoseconds, path) of all files, in order; hidden ones are left out."""
    system, path, _ = _at(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class _Parsed:
    """What a file's reader shares: options and the parser."""

    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"], options.get("kind", "feed")
        self.cards, self.host, self.snippet = options.get("cards", "article"), options.get("host", ""), options.get("snippet", "")
        if self.kind not in ("feed", "cards"):
            raise ValueError(f"kind is feed or cards, not {self.kind}")

    def rows(self, path: str) -> Iterator[tuple]:
        """Rows of one file; one that can't be parsed is a row with ``error``."""
        try:
            with _at(self.root)[0].open_input_stream(path) as f:
                content = f.read()
            found = _feed(path, content) if self.kind == "feed" else cards_in(content.decode(errors="replace"), self.cards, self.host, self.snippet)
        except Exception as e:  # noqa: BLE001  a broken file is recorded
            yield (path, -1, f"{type(e).__name__}: {e}"[:200], *[None] * len(NAMES))
            return
        for i, r in enumerate(found):
            yield (path, i, None, *[r.get(n) for n in NAMES])


class _Reader(_Parsed, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(p) for _, p in sorted(listed(self.root), key=lambda x: x[1])]

    def read(self, partition: File) -> Iterator[tuple]:
        return self.rows(partition.path)


class _Stream(_Parsed, DataSourceStreamReader):
    """Offsets are the last file by time of change and path; a file is read once, after it is there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(listed(self.root), default=(-1, ""))
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[File]:
        key = lambda o: (o["mtime"], o["path"])
        return [File(p) for m, p in listed(self.root) if key(start) < (m, p) <= key(end)]

    def read(self, partition: File) -> Iterator[tuple]:
        return self.rows(partition.path)

    def commit(self, end: dict) -> None:
        pass


class SavedSource(DataSource):
    """Options: path (a file or folder); kind: ``feed`` or ``cards``; for cards their selector, host and snippet."""

    @classmethod
    def name(cls) -> str:
        return "saved_source"

    def schema(self) -> str:
        return f"file string, item_ord long, error string, {STORY}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedSource)
