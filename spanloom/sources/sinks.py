"""Writing results: CSV, JSON lines, quoted tables, records by kind, archives of small files, and an object store."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.scan import opened


def write_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """A table in order; range partitions keep it over several files."""
    df.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def write_quoted(df: DataFrame, path: str) -> None:
    """All values in double quotes, a double quote in a value as a single one, without a header."""
    df.select(*[F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'")).alias(c) for c in df.columns]).write.mode("overwrite").option("quoteAll", "true").csv(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """A log: what is there stays."""
    df.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def store_by_kind(records: DataFrame, path: str) -> None:
    """value by kind, appended to a folder for each kind."""
    records.write.mode("append").partitionBy("kind").text(path)


def read_by_kind(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, kind string").text(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes a file for each row (path, text) below a folder, on the executors; the number of files.

    A file takes its name when it is whole, so a task that is run again only replaces files by equal ones. Paths that
    leave the folder are an error.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                clean = posixpath.normpath(path)
                if clean.startswith(("/", "..")) or clean == ".":
                    raise ValueError(f"not a path below the folder: {path!r}")
                at = f"{root}/{clean}"
                system.create_dir(posixpath.dirname(at), recursive=True)
                fresh = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(fresh) as out:
                    out.write((content or "").encode())
                system.move(fresh, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).head()[0] or 0


class Store:
    """Objects by key below a folder of any file system that Spark knows. Keys cannot leave the folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, key: str):
        clean = posixpath.normpath(key)
        if not key or clean.startswith(("/", "..")) or clean == ".":
            raise ValueError(f"not a key: {key!r}")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{clean}")
        return path.getFileSystem(self.conf), path

    def put(self, key: str, content: bytes) -> None:
        fs, path = self._at(key)
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()

    def get(self, key: str) -> bytes:
        fs, path = self._at(key)
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return bool(fs.delete(path, False))

    def keys(self, prefix: str = "") -> list[str]:
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.conf)
        if not fs.exists(path):
            return []
        base, found, files = fs.makeQualified(path).toString().rstrip("/") + "/", [], fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toString().removeprefix(base))
        return sorted(k for k in found if k.startswith(prefix) and not posixpath.basename(k).startswith("."))


def export_zip(store: Store, run: str, suffixes: tuple[str, ...] = (".csv", ".json", ".txt")) -> bytes:
    """The small result files of a run, below its name, in order: an archive in the driver's memory."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for key in store.keys(f"{run}/"):
            if key.lower().endswith(suffixes):
                archive.writestr(zipfile.ZipInfo(key, (2024, 1, 1, 0, 0, 0)), store.get(key))
    return out.getvalue()


def import_zip(store: Store, content: bytes, most: int = 1 << 30) -> list[str]:
    """Puts an archive's files back; names that leave the folder and archives that grow over `most` bytes raise an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        files = [x for x in archive.infolist() if not x.is_dir()]
        if sum(x.file_size for x in files) > most:
            raise ValueError("the archive is too large")
        for x in files:
            store._at(x.filename)  # every name is checked before anything is written
        for x in files:
            store.put(x.filename, archive.read(x))
    return [x.filename for x in files]
