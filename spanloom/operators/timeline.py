"""Events over time: pivots, as-of look-ups, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_intervals(log: DataFrame, step: str, starts: list[str], ends: list[str]) -> DataFrame:
    """position and width of each step from its last start to its last end, as shares of the whole time; a missing end is a millisecond later."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    last = lambda kinds: F.max(F.when(F.col("event_type").isin(*kinds), ms))
    s = log.groupBy(step).agg(last(starts).alias("a"), last(ends).alias("b")).filter("a IS NOT NULL").withColumn("b", F.coalesce("b", F.col("a") + 1))
    s = s.crossJoin(F.broadcast(s.agg(F.min("a").alias("lo"), F.max("b").alias("hi"))))
    span = F.col("hi") - F.col("lo")
    return s.select(step, ((F.col("a") - F.col("lo")) / span).alias("position"), ((F.col("b") - F.col("a")) / span).alias("width"))


def until(events: DataFrame, members: DataFrame, moment: str) -> DataFrame:
    """compound, n_events, last of the members' events up to a moment. members: user_id, compound."""
    early = events.filter(F.col("ts") <= F.lit(moment).cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("k"), F.max("ts").alias("t"))
    return early.join(members, "user_id").groupBy("compound").agg(F.sum("k").alias("n_events"), F.max("t").alias("last"))


def as_of(events: DataFrame, moment: str) -> DataFrame:
    """user_id and the kind of their last event up to a moment (the greatest id on a tie)."""
    return events.filter(F.col("ts").cast("timestamp") <= F.lit(moment).cast("timestamp")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n_before"))


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an ordered array."""
    a = min(1.0, max(0.0, alpha))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda prev, x: (1 - a) * prev + a * x)


def decay(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Smoothed value of each user's events of each day, in order of time."""
    days = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return days.select("user_id", "day", F.size("e").alias("n"), smoothed(F.transform("e", lambda x: x["value"]), alpha).alias("smoothed"))
