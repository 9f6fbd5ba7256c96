"""Tables that are addressed by the digest of what they are made from, and read again while that is unchanged."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RECORD = "name string, digest string, parameters string, inputs string, path string, made double"


class Results:
    """A folder of results. Each is a table under its name and digest, with a record beside it.

    The digest covers the name, the parameters and, of every file of the inputs, path, length and time of change. A
    table is written under a name of its own and moved into place when it is whole, so a run that was lost leaves
    nothing that is read, and of two that make the same table one is kept.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self, inputs: list[str]) -> list[tuple[str, int, int]]:
        found = []
        for name in sorted(inputs):
            path = self._path(name)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not fs.exists(path):
                raise FileNotFoundError(name)
            listing = fs.listFiles(path, True)
            while listing.hasNext():
                f = listing.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)

    def digest(self, name: str, inputs: list[str], parameters: dict) -> str:
        said = json.dumps([name, parameters, self._files(inputs)], sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()

    def table(self, name: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The result, and whether it was made now. `make` is called only if the table is not there."""
        digest = self.digest(name, inputs, parameters)
        path = f"{self.folder}/tables/{name}/{digest}"
        made = not self._fs.exists(self._path(path))
        if made:
            part = f"{self.folder}/parts/{uuid.uuid4().hex}"
            make().write.parquet(part)
            self._fs.mkdirs(self._path(path).getParent())
            # A rename onto a folder that is there would move into it: the first one stays.
            if self._fs.exists(self._path(path)) or not self._fs.rename(self._path(part), self._path(path)):
                self._fs.delete(self._path(part), True)
            record = {"name": name, "digest": digest, "parameters": json.dumps(parameters, sort_keys=True), "inputs": json.dumps(sorted(inputs)), "path": path, "made": time.time()}
            out = self._fs.create(self._path(f"{self.folder}/records/{name}-{digest}.json"), True)
            out.write(bytearray(json.dumps(record).encode()))
            out.close()
        return self.spark.read.parquet(path), made

    def catalog(self) -> DataFrame:
        """name, digest, parameters, inputs, path, made (seconds) of each table."""
        records = f"{self.folder}/records"
        if not self._fs.exists(self._path(records)):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(records)

    def clean(self, before: float | None = None) -> int:
        """Deletes tables whose inputs have changed or are gone, those made before a time, and parts of lost runs older than a day; returns the number of tables."""
        gone = 0
        for r in self.catalog().toLocalIterator():
            try:
                same = self.digest(r["name"], json.loads(r["inputs"]), json.loads(r["parameters"])) == r["digest"]
            except FileNotFoundError:
                same = False
            if not same or before is not None and r["made"] < before:
                # The record goes last, so that a clean that was lost is taken up by the next one.
                self._fs.delete(self._path(r["path"]), True)
                self._fs.delete(self._path(f"{self.folder}/records/{r['name']}-{r['digest']}.json"), False)
                gone += 1
        parts = self._path(f"{self.folder}/parts")
        for f in self._fs.listStatus(parts) if self._fs.exists(parts) else []:
            if f.getModificationTime() < (time.time() - 86_400) * 1000:
                self._fs.delete(f.getPath(), True)
        return gone
