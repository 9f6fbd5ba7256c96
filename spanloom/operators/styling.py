"""How nodes and edges of a graph are drawn: importance, sizes, fading, colours, labels. All as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scores
from spanloom.plans.tables import cut, ranked


def unit(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds each expression scaled to [0, 1] over all rows (0 if constant)."""
    made = scores.with_bounds(df, **{f"_{k}": c for k, c in columns.items()})
    made = made.withColumns({k: scores.scaled(f"_{k}", 0.0) for k in columns})
    return made.drop(*[f"_{k}{side}" for k in columns for side in ("", "_low", "_high")])


def node_styles(nodes: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """node, importance, size, halo, alpha, saturation, value, primary (whether it gets a label). nodes: node, degree, tf, df, coherence, stability."""
    n = unit(nodes, d=F.col("degree"), t=F.col("tf"), c=F.col("coherence"), s=F.col("stability"), f=F.col("df"))
    n = cut(unit(n.withColumn("raw", 0.40 * F.col("d") + 0.30 * F.col("t") + 0.30 * F.col("c")), importance=F.col("raw")))
    label = F.round(0.40 * F.col("importance") + 0.30 * F.col("s") + 0.30 * F.col("d"), 9)
    count = F.broadcast(n.agg(F.count("*").alias("_n")))
    placed = ranked(n.withColumn("_label", label), F.desc("_label"), F.col("node")).crossJoin(count)
    return placed.select(
        "node", "importance", (30.0 + 120.0 * F.col("importance")).alias("size"), (1.2 + 2.3 * F.col("s")).alias("halo"), (0.25 + 0.60 * F.col("f")).alias("alpha"),
        ((0.50 + 0.45 * F.col("s")) * (0.9 - 0.4 * F.col("c"))).alias("saturation"), (0.55 + 0.40 * F.col("importance")).alias("value"),
        (F.col("place") <= F.greatest(F.lit(least), F.floor(share * F.col("_n")))).alias("primary"),
    )


def edge_styles(edges: DataFrame) -> DataFrame:
    """source, target, width, alpha: steep in the scaled weight."""
    w = unit(edges, w=F.col("weight"))
    return w.select("source", "target", (0.15 + 2.3 * F.pow("w", F.lit(0.8))).alias("width"), (0.25 + 0.75 * F.pow("w", F.lit(0.7))).alias("alpha"))


def depth_importance(nodes: DataFrame) -> DataFrame:
    """node, importance of degree, frequency, coherence and stability, scaled."""
    n = unit(nodes, d=F.col("degree"), t=F.col("tf"), c=F.col("coherence"), s=F.col("stability"))
    return unit(cut(n.withColumn("raw", 0.25 * F.col("d") + 0.30 * F.col("t") + 0.25 * F.col("c") + 0.20 * F.col("s"))), importance=F.col("raw")).select("node", "importance")


def rgba(hue: Column, saturation: Column, value: Column, alpha: float = 1.0) -> dict[str, Column]:
    """Red, green, blue and alpha of a colour given by hue, saturation and value."""
    h = (hue - F.floor(hue)) * 6.0
    sector, f = F.floor(h) % 6, h - F.floor(h)
    p, q, t = value * (1 - saturation), value * (1 - f * saturation), value * (1 - (1 - f) * saturation)
    pick = lambda *parts: F.element_at(F.array(*parts), (sector + 1).cast("int"))
    return {"r": pick(value, q, p, p, t, value), "g": pick(t, value, value, q, p, p), "b": pick(p, p, t, value, value, q), "a": F.lit(alpha)}


def histogram(df: DataFrame, value: str, least: int = 15, most: int = 60) -> DataFrame:
    """bin, low, n: equal bins, about the square root of the rows many. Empty bins are left out."""
    stats = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count("*").alias("all"))
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.sqrt("all")) + 5))
    placed = df.select(F.col(value).cast("double").alias("x")).crossJoin(F.broadcast(stats.withColumn("bins", bins)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("lo")) / width))).otherwise(0)
    return placed.withColumn("bin", place.cast("long")).groupBy("bin").agg(F.count("*").alias("n"), F.max(F.col("lo") + F.col("bin") * width).alias("low")).select("bin", "low", "n")


def radial(nodes: DataFrame) -> DataFrame:
    """node, x, y: a sector for each group, the nodes with the most edges nearest to the centre. nodes: node, degree, group."""
    sectors = ranked(nodes.select("group").distinct(), "group").withColumn("sector", F.col("place") - 1).select("group", "sector")
    own = Window.partitionBy("group")
    placed = nodes.withColumn("place", F.row_number().over(own.orderBy(F.desc("degree"), "node")) - 1).withColumn("size", F.count("*").over(own))
    k = F.broadcast(sectors.agg((F.max("sector") + 1).alias("sectors")))
    j = placed.join(sectors, "group").crossJoin(k)
    far, angle = (1.0 + F.col("place")) / F.col("size"), 2 * math.pi * (F.col("sector") + (F.col("place") + 0.5) / F.col("size")) / F.col("sectors")
    return j.select("node", (far * F.cos(angle)).alias("x"), (far * F.sin(angle)).alias("y"))
