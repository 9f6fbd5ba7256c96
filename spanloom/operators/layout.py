"""Spring layouts of graphs, in two or three dimensions, with repulsion from a pyramid of grid cells."""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.tables import cut, remove

#: Levels whose cells are few enough for a broadcast, whatever the graph: 4 ** 6 cells of the last one, or 8 ** 4.
COARSE = {2: 6, 3: 4}


def _axes(nodes: DataFrame) -> list[str]:
    return [a for a in ("x", "y", "z") if a in nodes.columns]


def _sum(parts) -> Column:
    return functools.reduce(operator.add, parts)


def _push(own: list[Column], other: list[Column], mass: Column, soft: float) -> list[Column]:
    """The push on a point from a mass elsewhere: the distance vector over the square of its length."""
    away = [a - b for a, b in zip(own, other, strict=True)]
    square = _sum(d * d for d in away) + soft
    return [mass * d / square for d in away]


def _shifted(axes: list[str], prefix: str) -> Column:
    """The key of a cell and those of all cells that touch it."""
    keys = [F.struct(*[(F.col(f"{prefix}{a}") + s).alias(f"k{a}") for a, s in zip(axes, shift, strict=True)]) for shift in itertools.product((-1, 0, 1), repeat=len(axes))]
    return F.explode(F.array(*keys))


#: Levels after which nodes count as being in one place.
DEEPEST = 24


def grid(nodes: DataFrame, depth: int | None = None, leaf: int = 32) -> tuple[DataFrame, int]:
    """Nodes with their cell of the finest level, and the number of levels.

    There is a cell or more for each node, and heaps of nodes are halved on, two levels at a time, until no cell has
    more than `leaf` nodes: a job for each time, that counts cells.
    """
    axes = _axes(nodes)
    box = nodes.agg(F.count("*").alias("n"), *[f(a).alias(f"{name}{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max))]).head()
    side = max([box[f"hi{a}"] - box[f"lo{a}"] for a in axes]) * (1 + 1e-9) or 1.0 if box["n"] else 1.0
    deeper, depth = depth is None, depth or max(2, math.ceil(math.log(max(2, box["n"]), 2 ** len(axes))) + 1)
    cell = lambda k: {f"c{a}": F.least(F.lit(2**k - 1), F.floor((F.col(a) - (box[f"lo{a}"] or 0.0)) / side * 2**k)) for a in axes}
    while deeper and depth < DEEPEST and nodes.select(*[c.alias(a) for a, c in cell(depth).items()]).groupBy(*cell(depth)).count().filter(F.col("count") > leaf).head(1):
        depth = min(DEEPEST, depth + 2)
    return nodes.withColumns(cell(depth)), depth


def repulsion(nodes: DataFrame, depth: int | None = None, leaf: int = 32, soft: float = 1e-12) -> DataFrame:
    """id, f<axis>: for each node the sum over all others of the distance vector over the square of its length.

    The box is halved level by level. What lies in cells that touch a node's own at no level so far, though their
    parents touch, acts from its centre; a node meets at most 27 such cells a level (189 in three dimensions). In the
    cells around it on the finest level nodes act one by one, but cells of more than `leaf` nodes, which are left at a
    given or at the deepest level only, act as a whole (a node's own without the node), so no step has pairs in the
    square of a cell's size. In the tests the error is under a twentieth of the forces' sum. nodes: id, x, y and perhaps z.
    """
    axes = _axes(nodes)
    placed, depth = grid(nodes.select("id", *axes), depth, leaf)
    placed = cut(placed)
    cell = [f"c{a}" for a in axes]
    fine = placed.groupBy(*cell).agg(F.count("*").alias("m"), *[F.sum(a).alias(f"s{a}") for a in axes])
    levels = F.explode(F.sequence(F.lit(2), F.lit(depth))).alias("level")
    up = [F.expr(f"shiftright(c{a}, {depth} - level)").alias(f"c{a}") for a in axes]
    cells = cut(fine.select("*", levels).select("level", *up, "m", *[f"s{a}" for a in axes]).groupBy("level", *cell).agg(F.sum("m").alias("m"), *[(F.sum(f"s{a}") / F.sum("m")).alias(f"g{a}") for a in axes]))

    parents = cells.withColumns({f"p{a}": F.expr(f"shiftright(c{a}, 1)") for a in axes})
    sources = parents.select("level", *[F.col(f"c{a}").alias(f"o{a}") for a in axes], "m", *[f"g{a}" for a in axes], _shifted(axes, "p").alias("k")).select("*", *[F.col(f"k.k{a}").alias(f"p{a}") for a in axes]).drop("k")
    apart = functools.reduce(operator.or_, [F.abs(F.col(f"c{a}") - F.col(f"o{a}")) > 1 for a in axes])
    targets = parents.select("level", *cell, *[f"p{a}" for a in axes])
    lists = cut(targets.join(sources, ["level", *[f"p{a}" for a in axes]]).filter(apart).groupBy("level", *cell).agg(F.collect_list(F.struct("m", *[f"g{a}" for a in axes])).alias("far")))

    at = placed.select("id", *axes, *cell, levels).select("id", "level", *axes, *up)

    def acting(k: int) -> Column:
        return F.aggregate("far", F.lit(0.0), lambda s, o: s + _push([F.col(a) for a in axes], [o[f"g{a}"] for a in axes], o["m"], soft)[k])

    coarse = F.col("level") <= COARSE[len(axes)]
    found = [at.filter(coarse).join(F.broadcast(lists.filter(coarse)), ["level", *cell]), at.filter(~coarse).join(lists.filter(~coarse), ["level", *cell])]
    parts = [df.select("id", *[acting(k).alias(f"f{a}") for k, a in enumerate(axes)]) for df in found]

    around = placed.select("id", *axes, *[F.col(f"c{a}").alias(f"h{a}") for a in axes], _shifted(axes, "c").alias("k")).select("*", *[F.col(f"k.k{a}").alias(f"c{a}") for a in axes]).drop("k")
    near = around.join(cells.filter(F.col("level") == depth).drop("level"), cell)
    own = functools.reduce(operator.and_, [F.col(f"c{a}") == F.col(f"h{a}") for a in axes])
    whole = near.filter(F.col("m") > leaf).withColumn("rest", F.when(own, F.col("m") - 1).otherwise(F.col("m")))
    centre = [F.when(own, (F.col(f"g{a}") * F.col("m") - F.col(a)) / F.col("rest")).otherwise(F.col(f"g{a}")) for a in axes]
    parts.append(whole.select("id", *[p.alias(f"f{a}") for a, p in zip(axes, _push([F.col(a) for a in axes], centre, F.col("rest"), soft), strict=True)]))
    others = placed.select(F.col("id").alias("other"), *[F.col(a).alias(f"g{a}") for a in axes], *cell)
    single = near.filter(F.col("m") <= leaf).select("id", *axes, *cell).join(others, cell).filter("id <> other")
    parts.append(single.select("id", *[p.alias(f"f{a}") for a, p in zip(axes, _push([F.col(a) for a in axes], [F.col(f"g{a}") for a in axes], F.lit(1), soft), strict=True)]))
    every = functools.reduce(DataFrame.union, [placed.select("id", *[F.lit(0.0).alias(f"f{a}") for a in axes]), *parts])
    return every.groupBy("id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in axes])


def attraction(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, f<axis>: for each node the sum over its edges of weight times length times the distance vector. edges: source, target, weight."""
    axes = _axes(nodes)
    end = lambda name, p: nodes.select(F.col("id").alias(name), *[F.col(a).alias(f"{p}{a}") for a in axes])
    spans = edges.filter("source <> target").join(end("source", "s"), "source").join(end("target", "t"), "target")
    away = {a: F.col(f"t{a}") - F.col(f"s{a}") for a in axes}
    pull = F.col("weight") * F.sqrt(_sum(d * d for d in away.values()))
    one = [F.struct(F.col(name).alias("id"), *[(sign * pull * away[a]).alias(f"f{a}") for a in axes]) for name, sign in (("source", 1.0), ("target", -1.0))]
    return spans.select(F.inline(F.array(*one))).groupBy("id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in axes])


def spring(nodes: DataFrame, edges: DataFrame, k: float | None = None, rounds: int = 160, tolerance: float = 1e-4) -> DataFrame:
    """id, x, y (z): positions where springs along edges and repulsion between all nodes meet.

    Each round moves a node along its force, at most by a heat that falls from a tenth of the box to nothing over
    `rounds`; it ends sooner when the mean move is under `tolerance`. Weights are scaled to a largest one of 1. The
    rest length `k` depends on the mean degree. Positions are tables, and only sums reach the driver.
    """
    axes = _axes(nodes)
    here = cut(nodes.select("id", *[F.col(a).cast("double").alias(a) for a in axes]))
    n = here.count()
    n_edges, most = edges.filter("source <> target").agg(F.count("*"), F.max("weight")).head()
    if not n or not n_edges:
        return here
    scaled = cut(edges.select("source", "target", (F.col("weight") / float(most)).alias("weight")))
    degree = 2 * n_edges / n
    k = k or (3.2 if degree < 2 else 2.2 if degree < 5 else 1.4) / math.sqrt(n)
    box = here.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).head()
    heat = max(box) / 10 or 0.1
    for step in range(rounds):
        both = repulsion(here).join(attraction(here, scaled).select("id", *[F.col(f"f{a}").alias(f"a{a}") for a in axes]), "id", "left")
        force = both.select("id", *[(F.col(f"f{a}") * k * k + F.coalesce(f"a{a}", F.lit(0.0)) / k).alias(f"f{a}") for a in axes])
        length = F.sqrt(_sum(F.col(f"f{a}") ** 2 for a in axes))
        move = F.least(length, F.lit(heat * (1 - step / rounds)))
        moved = cut(here.join(force, "id").withColumn("_l", length).withColumn("_m", move).select("id", *[(F.col(a) + F.when(F.col("_l") > 0, F.col(f"f{a}") / F.col("_l") * F.col("_m")).otherwise(0.0)).alias(a) for a in axes], "_m"))
        remove(here)
        here = moved.drop("_m")
        here._cut = moved._cut
        if moved.agg(F.avg("_m")).head()[0] < tolerance:
            break
    return here
