"""A folder of text files as a Spark data source of its own, for batches and streams.

`spark.read.format("corpus_files").load(folder)` gives a row for each file. Files are listed once, in order of their
paths; suffixes and the number of files are settled there, before any file is opened, and partitions are made by bytes.
As a stream it gives the files that have come since: its offset is the newest file's time and path, so nothing has to
be remembered but the offset itself. Folders are addresses of any file system that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


@dataclass
class Files(InputPartition):
    """Some files of one task: their paths below the folder."""

    paths: list[str]


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    time: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class CorpusReader:
    """Lists, deals and reads files. Options: path, suffixes (by comma), max_docs, partition_bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.suffixes = tuple("." + s.strip().lower().lstrip(".") for s in options.get("suffixes", "").split(",") if s.strip())
        self.max_docs = int(options.get("max_docs", 0)) or None
        self.bytes = int(options.get("partition_bytes", 64 << 20))

    def listed(self) -> list[Found]:
        system, root = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [Found(f.path[len(root) :].lstrip("/"), f.size or 0, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f for f in files if not self.suffixes or f.path.lower().endswith(self.suffixes)), key=lambda f: f.path)

    def dealt(self, files: list[Found]) -> list[Files]:
        """Files in a row, as many to a partition as it has bytes for; a larger file is one of its own."""
        parts, room = [], 0
        for f in files:
            if not parts or room < f.size:
                parts.append(Files([]))
                room = self.bytes
            parts[-1].paths.append(f.path)
            room -= f.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = opened(self.folder)
        for path in partition.paths:
            with system.open_input_stream(f"{root}/{path}") as stream:
                content = stream.read()
            name = path.rsplit("/", 1)[-1]
            yield path, "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else "", len(content), content.decode("utf-8", "replace")


class BatchReader(CorpusReader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()[: self.max_docs])


class StreamReader(CorpusReader, DataSourceStreamReader):
    """Files between two offsets, by their time and path."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(((f.time, f.path) for f in self.listed()), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return self.dealt([f for f in self.listed() if low < (f.time, f.path) <= high])

    def commit(self, end: dict) -> None:
        """Nothing is kept."""


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "path string, suffix string, size_bytes long, text string"

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; again does no harm."""
    spark.dataSource.register(CorpusFiles)
