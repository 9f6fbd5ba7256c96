"""Streams of events: windowed counts with a watermark, keyed smoothing, and batched ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.plans.tables import new_path


def stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 5) -> DataFrame:
    """A table's files as a stream, a few at a time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def smoothing(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """event_type, n, smoothed: exponential smoothing whose state outlives the batches; a batch's values go in order of time."""

    def update(key, frames, state: GroupState):
        n, value = state.get if state.exists else (0, None)
        for x in pd.concat(frames).sort_values(["ts", "event_id"])["value"]:
            value, n = (x if value is None else (1 - alpha) * value + alpha * x), n + 1
        state.update((n, value))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "smoothed": [value]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, smoothed double", "n long, smoothed double", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str) -> DataFrame:
    """What a stream yields when all input at hand has been read: the last batch in complete mode, else all batches.

    Batches are written to the shared folder by the executors; a batch that is run again replaces its files.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    query = df.writeStream.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = query.lastProgress is not None and spark.read.schema(df.schema.add("batch", "long")).parquet(f"{path}/out")
    if batches is False:
        return spark.createDataFrame([], df.schema)
    last = batches.agg(F.max("batch").alias("_last"))
    return (batches.crossJoin(F.broadcast(last)).filter("batch = _last") if mode == "complete" else batches).select(*df.columns)
