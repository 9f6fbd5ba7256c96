"""A small agent simulation: seeded state, steps, injections and metrics, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.tables import cut


def clamp(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def init(spark: SparkSession, n: int = 256, seed: int = 7) -> DataFrame:
    """agent, x, y, belief, regime (70, 20 and 10 percent)."""
    r = F.rand(seed + 3)
    state = spark.range(n if n > 0 else 256).withColumnRenamed("id", "agent")
    return cut(state.select("agent", F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"), (0.5 + 0.2 * (F.rand(seed + 2) - 0.5)).alias("belief"), F.when(r < 0.7, 0).when(r < 0.9, 1).otherwise(2).alias("regime")))


def step(state: DataFrame, dt: float = 1.0, seed: int = 0) -> DataFrame:
    """A random walk, and beliefs that relax to their mean with noise."""
    mean = F.broadcast(state.agg(F.avg("belief").alias("mean")))
    noise = lambda k: 2 * F.rand(seed * 3 + k) - 1
    belief = F.col("belief") + 0.05 * dt * (F.col("mean") - F.col("belief")) + 0.02 * dt * noise(3)
    return cut(state.crossJoin(mean).select("agent", clamp(F.col("x") + 0.01 * noise(1)).alias("x"), clamp(F.col("y") + 0.01 * noise(2)).alias("y"), clamp(belief).alias("belief"), "regime"))


def inject(state: DataFrame, x: float, y: float, radius: float, belief: float, regime: int) -> DataFrame:
    """Within a radius the regime is set and beliefs are blended, more so near the centre."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    w = 1 - d2 / radius**2
    hit = d2 <= radius**2
    return state.withColumn("belief", F.when(hit, clamp((1 - w) * F.col("belief") + w * belief)).otherwise(F.col("belief"))).withColumn("regime", F.when(hit, F.lit(regime)).otherwise(F.col("regime")))


def metrics(state: DataFrame) -> DataFrame:
    """mean, population variance, entropy of regimes in nats: one row."""
    shares = state.groupBy("regime").agg(F.count("*").alias("n")).crossJoin(F.broadcast(state.agg(F.count("*").alias("all")))).withColumn("p", F.col("n") / F.col("all"))
    return state.agg(F.avg("belief").alias("mean_belief"), F.var_pop("belief").alias("var_belief")).crossJoin(shares.agg((-F.sum(F.col("p") * F.log("p"))).alias("regime_entropy")))


def export(state: DataFrame, path: str) -> None:
    """The agents as JSON lines."""
    state.select("agent", "x", "y", "belief", "regime").write.mode("overwrite").json(path)
