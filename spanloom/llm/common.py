"""What the operators share: word splitting, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of characters other than these (space, tab, \n, \v, \f, \r).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none. A split at single spaces needs no pattern."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " "), " "), "")


def windows_of(words: str, width: int) -> Column:
    """A 64-bit hash of each window of `width` words of an array column (null if there are fewer words).

    The outer transform binds the array once, so that its elements are read without unpacking the row each time.
    """
    each = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, F.get(F.transform(F.array(words), each), F.lit(0)))


def named(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`").alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process, as in tests."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        atexit.register(__import__("shutil").rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}/{tag}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this module, by Hadoop's file system."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each finished action are deleted at once instead of at some garbage collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, and its path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType, size: int = 512) -> DataFrame:
    """mapInArrow with a function from batches to dicts of columns, each a list or an Arrow array.

    Spark's batches may hold 64 MB; the function sees at most `size` rows at a time, which bounds what it makes of them.
    """
    kind = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(k, size) for batch in batches for k in range(0, batch.num_rows, size))
        for columns in rows(slices):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)
