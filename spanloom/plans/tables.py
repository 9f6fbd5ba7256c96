"""Tables that cut a lineage, in the folder that driver and executors share, and ranks over whole tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._cut = path
    return found


def remove(df: DataFrame) -> None:
    """Deletes a table that cut() made and that is not read any more."""
    remove_path(df.sparkSession, df._cut)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quantile(df: DataFrame, column: str, share: float, bins: int = 2_048) -> float | None:
    """The exact percentile of a column's numbers, interpolated between neighbours; None if there are none.

    Each pass counts values in bins and goes on inside the bin of the wanted rank, from its least to its largest value,
    until these are equal. What reaches the driver is a row for each bin; no task holds the values.
    """
    x = F.col(column).cast("double")
    values = df.filter(x.isNotNull()).select(x.alias("x"))
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).head()
    if not n:
        return None
    place = (n - 1) * share
    rank, before = int(place), 0
    while low < high:
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / (high - low) * bins))
        counts = values.filter(F.col("x").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["b"]):
            if before + r["n"] > rank:
                low, high = r["lo"], r["hi"]
                break
            before += r["n"]
    if place == rank:
        return low
    upto, after = values.agg(F.count(F.when(F.col("x") <= low, 1)), F.min(F.when(F.col("x") > low, F.col("x")))).head()
    return low + (place - rank) * ((low if upto > rank + 1 else after) - low)


def ranked(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row in an order that has no ties.

    Rows are range-partitioned and numbered inside their partition; what comes before is a table with a row for each
    partition, so no task sees more than one partition's rows.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # A row for each shuffle partition is broadcast.
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_offset")).drop("_part", "_in", "_offset")
