"""Feed documents as a Spark data source, batch and stream: `spark.read.format("feed_documents").load(folder)`.

A landing folder holds one document a file, whose name (without suffix) is the feed unless it lies in a folder of the
feed's name. Rows: feed, content, file, error. A file that can't be read as text, or holds no item, is a row with its error
and no content, so nothing is lost and nothing stops. Files are dealt to partitions by their bytes. A stream's offset is
the last file in order of time and name; files are taken once, in that order, and are expected to be whole when they
appear (moved into the folder).

Folders are any path that pyarrow's file systems open, on storage that all executors share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.sources.feeds import feed_items

SCHEMA = "feed string, content string, file string, error string"
DECLARED = re.compile(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)")
BLOCKS = re.compile(r"<(item|entry)\b", re.I)


def opened(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def listed(folder: str) -> list[tuple[int, str, int]]:
    """(time in microseconds, path, bytes) of all files, in order."""
    from pyarrow import fs

    system, root = opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((int(f.mtime.timestamp() * 1e6), f.path, f.size) for f in files)


def decoded(raw: bytes) -> tuple[str | None, str | None]:
    """(text, None) or (None, what is wrong): by a byte order mark, the declared encoding, or UTF-8."""
    if not raw.strip():
        return None, "empty"
    declared = DECLARED.search(raw[:200])
    name = "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else declared[1].decode() if declared else "utf-8-sig"
    try:
        text = raw.decode(name)
    except (UnicodeDecodeError, LookupError) as error:
        return None, f"not {name}: {type(error).__name__}"
    return (text, None) if BLOCKS.search(text) else (None, "no item")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files in parts of about so many bytes."""
    parts: list[list[str]] = []
    held = 0
    for _, path, size in files:
        if not parts or held + size > most:
            parts.append([])
            held = 0
        parts[-1].append(path)
        held += size
    return [Files(p) for p in parts]


def rows_of(folder: str, paths: list[str]) -> Iterator[tuple]:
    system, root = opened(folder)
    for path in paths:
        inside = path[len(root.rstrip("/")) + 1 :]
        feed = inside.split("/")[0] if "/" in inside else re.sub(r"\.[^.]*$", "", inside)
        try:
            with system.open_input_stream(path) as f:
                text, error = decoded(f.read())
        except OSError as lost:
            text, error = None, f"unreadable: {type(lost).__name__}"
        yield feed, text, path, error


class Reader(DataSourceReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        return dealt(listed(self.folder), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.folder, partition.paths)


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.folder) if low < f[:2] <= high], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.folder, partition.paths)


class FeedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_documents"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("load(folder) needs a folder")
        return self.options["path"], int(self.options.get("partitionbytes", 16 << 20))

    def reader(self, schema: object) -> Reader:
        return Reader(*self._args())

    def streamReader(self, schema: object) -> StreamReader:  # noqa: N802
        return StreamReader(*self._args())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedDocuments)


def items_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feed items of the documents that could be read, batch or stream, and the quarantined documents."""
    return feed_items(documents.where(F.col("error").isNull())), documents.where(F.col("error").isNotNull()).drop("content")
