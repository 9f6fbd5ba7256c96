"""Co-occurrence graphs: edges, pruning, components, scores and statistics, all as joins and aggregates.

Edges have source < target. Nodes are whatever type the elements have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scores
from spanloom.operators.blocks import Blocks, Piece, summed
from spanloom.plans.tables import cut, quantile, ranked, remove


def cooccurrence(occurrences: DataFrame, span: str, element: str, most: int = 2_000) -> DataFrame:
    """source, target, weight: in how many spans both occur.

    Pairs are made inside a row of a span's elements. A span of more than `most` elements is dealt to groups of them,
    and each two groups make a row of their own.
    """
    distinct = occurrences.select(F.col(span).alias("s"), F.col(element).alias("x")).distinct()
    large = cut(distinct.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    small = distinct if large.isEmpty() else distinct.join(large, "s", "left_anti")
    sets = small.groupBy("s").agg(F.sort_array(F.collect_list("x")).alias("e")).filter(F.size("e") > 1)
    firsts = sets.select("e", F.posexplode("e").alias("i", "source"))
    pairs = firsts.select("source", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("target"))
    if not large.isEmpty():
        groups = F.ceil(F.col("n") / most).cast("int")
        dealt = distinct.join(large, "s").withColumn("g", F.pmod(F.xxhash64("x"), groups).cast("int"))
        one = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), groups - 1))).groupBy("s", "g", "h").agg(F.collect_list("x").alias("a"))
        other = dealt.groupBy("s", F.col("g").alias("h")).agg(F.collect_list("x").alias("b"))
        both = one.join(other, ["s", "h"]).select("b", F.explode("a").alias("source"))
        pairs = pairs.union(both.select("source", F.explode("b").alias("target")).filter("source < target"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def top_per_node(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k heaviest of either end."""
    by_source = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
    by_target = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("weight"), "source"))
    return edges.withColumn("a", by_source).withColumn("b", by_target).filter((F.col("a") <= k) | (F.col("b") <= k)).drop("a", "b")


def with_weights(edges: DataFrame) -> DataFrame:
    """scaled_weight, confidence. The extremes are one row, joined back."""
    df = edges.crossJoin(F.broadcast(edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return df.withColumn("scaled_weight", scaled).withColumn("confidence", F.log1p("weight") / F.log1p("hi")).drop("lo", "hi")


def with_backbone(edges: DataFrame, share: float = 0.2) -> DataFrame:
    """is_backbone: the heaviest share of all edges, at least one."""
    total = F.broadcast(edges.agg(F.count("*").alias("m")))
    placed = ranked(edges, F.desc("weight"), F.col("source"), F.col("target")).crossJoin(total)
    return placed.withColumn("is_backbone", F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("m") * share))).drop("place", "m")


def with_scores(edges: DataFrame, share: float = 0.2) -> DataFrame:
    """scaled_weight, confidence, is_backbone."""
    return with_backbone(with_weights(edges), share)


def coerced(raw: DataFrame) -> DataFrame:
    """Edges whose weights are numbers; what is none counts as 0."""
    return raw.withColumn("weight", F.coalesce(F.expr("try_cast(weight as double)"), F.lit(0.0)))


def valid(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Edges of positive weight between known nodes, no loops."""
    at = lambda df, side: df.select(F.col("node").alias(side))
    kept = edges.filter("source <> target AND weight > 0").join(at(sources, "source"), "source", "left_semi")
    return kept.join(at(sources if targets is None else targets, "target"), "target", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other, weight: both directions of the edges of some nodes."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").union(edges.select("target", "source", "weight"))
    return both.join(nodes, "node", "left_semi")


def large_components(members: DataFrame, least: int) -> DataFrame:
    """Members of components of at least `least` nodes; of all if there are none. members: node, component."""
    sizes = members.groupBy("component").agg(F.count("*").alias("_size"))
    some = F.broadcast(sizes.agg(F.max("_size").alias("_most")))
    return members.join(sizes, "component").crossJoin(some).filter((F.col("_size") >= least) | (F.col("_most") < least)).select(*members.columns)


def compound_aggregates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each component. nodes: node, component, local_stability, temperature, coherence, info, mis, dis.

    Bonds count if both ends are in the component; without one the mean of local stabilities stands in for theirs.
    """
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    inner = edges.join(at("source"), "source").join(at("target"), "target").filter("source_c = target_c").groupBy(F.col("source_c").alias("component")).agg(F.count("*").alias("num_bonds"), F.avg("weight").alias("_w"))
    mean = {"mean_local_stability": "local_stability", "mean_temperature": "temperature", "mean_info": "info", "mean_misinfo": "mis", "mean_disinfo": "dis", "mean_coherence": "coherence"}
    own = nodes.groupBy("component").agg(F.countDistinct("node").alias("num_elements"), *[F.avg(c).alias(k) for k, c in mean.items()], F.var_pop("local_stability").alias("stability_variance"))
    joined = own.join(inner, "component", "left")
    return joined.withColumn("num_bonds", F.coalesce("num_bonds", F.lit(0))).withColumn("compound_stability", F.coalesce("_w", "mean_local_stability")).drop("_w")


def structure(nodes: DataFrame, edges: DataFrame, freq: DataFrame, rare: float) -> DataFrame:
    """node, is_isolate, is_leaf, is_rare_leaf, in_chain. freq: node, df; rare: up to that share of the mean frequency."""
    chain = chains(edges).select("node", F.lit(True).alias("_chain"))
    bar = F.broadcast(freq.agg(F.avg("df").alias("_mean")))
    j = nodes.join(degree(edges), "node", "left").join(freq, "node", "left").join(chain, "node", "left").crossJoin(bar)
    leaf = F.coalesce(F.col("degree") == 1, F.lit(False))
    return j.select("node", F.col("degree").isNull().alias("is_isolate"), leaf.alias("is_leaf"), F.coalesce(leaf & (F.col("df") <= rare * F.col("_mean")), F.lit(False)).alias("is_rare_leaf"), F.coalesce("_chain", F.lit(False)).alias("in_chain"))


def pruned(edges: DataFrame, mode: str = "none", k: int = 2_000) -> DataFrame:
    """Edges by a named rule: median, thermal, topk; any other keeps all. edges: importance, source_z, target_z."""
    if mode == "median":
        return prune(edges, F.col("importance"), 0.5)
    if mode == "thermal":
        return prune(edges, F.col("importance"), 0.5, (F.col("source_z") > 0) & (F.col("target_z") > 0))
    if mode == "topk":
        return edges.orderBy(F.desc(F.round("importance", 9)), "source", "target").limit(k)
    return edges


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """node and the edge's columns, a row for either end."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), *columns)


def degree(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def local_stability(scored: DataFrame) -> DataFrame:
    """Mean of weight times confidence over a node's edges, and its degree."""
    return ends(scored, "weight", "confidence").groupBy("node").agg(F.avg(F.col("weight") * F.col("confidence")).alias("local_stability"), F.count("*").alias("degree"))


def labels(blocks: Blocks, max_rounds: int = 50) -> DataFrame:
    """State label: the least number of each node's component. Minimum labels spread over edges and jump to their labels' labels each round."""

    def spread(i: int, rows: int, pieces: list[Piece], held: dict) -> dict:
        given = np.frombuffer(held[i]["label"], np.int64)
        near = given.copy()
        firsts = [np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) for _, r, _, _ in pieces]
        # A few turns inside the block; only its own labels change in them.
        for turn in range(4):
            for (j, r, c, _), first in zip(pieces, firsts, strict=True):
                if turn == 0 or j == i:
                    x = near if j == i else np.frombuffer(held[j]["label"], np.int64)
                    near[r[first]] = np.minimum(near[r[first]], np.minimum.reduceat(x[c], first))
        return {"i": [i], "label": [near.tobytes()], "moved": [bool((near < given).any())]}

    before = cut(blocks.state(blocks.nodes.select("number", F.col("number").alias("label")), label="i8"))
    for _ in range(max_rounds):
        near = cut(blocks.step(before, spread, "i int, label binary, moved boolean", ["label"]))
        remove(before)
        if not near.agg(F.max("moved")).head()[0]:
            return near
        rows = blocks.rows(near, label="i8")
        jump = rows.join(rows.select(F.col("number").alias("label"), F.col("label").alias("further")), "label").select("number", F.least("label", "further").alias("label"))
        before = cut(blocks.state(jump, label="i8"))
        remove(near)
    raise RuntimeError("the components have not settled")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its least node)."""
    blocks = Blocks(edges)
    if blocks.empty:
        return blocks.nodes.select("node", F.col("node").alias("component"))
    near = labels(blocks, max_rounds)
    names = blocks.nodes.select(F.col("number").alias("label"), F.col("node").alias("component"))
    found = cut(blocks.nodes.join(blocks.rows(near, label="i8"), "number").join(names, "label").select("node", "component"))
    remove(near)
    blocks.remove()
    return found


def named(components_: DataFrame, form: str = "C%04d") -> DataFrame:
    """Adds compound_id, numbered by least node."""
    names = ranked(components_.select("component").distinct(), "component").select("component", F.format_string(form, "place").alias("compound_id"))
    return components_.join(names, "component").select(*components_.columns, "compound_id")


def compounds(scored: DataFrame, members: DataFrame) -> DataFrame:
    """Per component: n_elements, n_bonds, stability (mean weight of its edges)."""
    nodes = members.groupBy("compound_id").agg(F.count("*").alias("n_elements"))
    inner = scored.join(members.select(F.col("node").alias("source"), "compound_id"), "source").groupBy("compound_id").agg(F.count("*").alias("n_bonds"), F.avg("weight").alias("stability"))
    return nodes.join(inner, "compound_id", "left")


def with_sizes(members: DataFrame) -> DataFrame:
    """Adds size: how many members the compound has."""
    return members.join(members.groupBy("compound_id").agg(F.count("*").alias("size")), "compound_id").select(*members.columns, "size")


def with_importance(scored: DataFrame, members: DataFrame, z: DataFrame, *carried: str) -> DataFrame:
    """Importance of edges from weight, shared compound, shared root and likeness of the ends' z; and what else of the members either end carries. z: node, z, root."""
    # The nodes are joined once, and so are the edges: extremes are taken of what is written.
    nodes = cut(members.join(z, "node"))
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("compound_id").alias(f"{side}_c"), F.col("z").alias(f"{side}_z"), F.col("root").alias(f"{side}_r"), *[F.col(c).alias(f"{side}_{c}") for c in carried])
    df = cut(scored.join(at("source"), "source").join(at("target"), "target"))
    same = lambda k: F.col(f"source_{k}").eqNullSafe(F.col(f"target_{k}")).cast("double")
    df = scores.with_bounds(df, weight=F.col("weight"))
    raw = 0.5 * scores.scaled("weight") + 0.2 * same("c") + 0.15 * same("r") + 0.15 * (1 - F.tanh(F.abs(F.col("source_z") - F.col("target_z"))))
    return scores.minmax(df.withColumn("raw", F.round(raw, 9)).drop("weight_low", "weight_high"), F.col("raw"), "importance").drop("raw")


def prune(edges: DataFrame, by: Column, share: float, among: Column | None = None) -> DataFrame:
    """Edges whose score is at least the given percentile (of those `among`, if there are any)."""
    scored = edges.withColumn("_s", by)
    # What the passes of a percentile read: numbers alone.
    values = cut(scored.select("_s", (F.lit(True) if among is None else among).alias("_among")))
    bar = quantile(values.filter("_among"), "_s", share)
    bar = quantile(values, "_s", share) if bar is None else bar
    remove(values)
    return scored.filter(F.col("_s") >= F.lit(bar)).drop("_s")


def triangles(edges: DataFrame) -> DataFrame:
    """Closed triples, one row with their number. Each edge is there once.

    Nodes are numbered by degree (by id on a tie) and edges point to the larger number, so that no node has more than
    the square root of twice the edges going out. Paths of two are not made as rows: an edge carries the later ends
    of its lower node's list, four bytes each, to the list of its upper node, and what both hold closes a triangle.
    """
    number = cut(ranked(degree(edges), "degree", "node").select("node", F.col("place").cast("int").alias("number")))
    at = lambda side, name: number.select(F.col("node").alias(side), F.col("number").alias(name))
    known = edges.select("source", "target").join(at("source", "a"), "source").join(at("target", "b"), "target")
    lists = cut(known.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("ends")))
    later = lists.select("ends", F.posexplode("ends").alias("i", "v")).select("v", F.slice("ends", F.col("i") + 2, F.size("ends")).alias("later")).filter(F.size("later") > 0)
    closed = later.join(lists.select(F.col("u").alias("v"), F.col("ends").alias("own")), "v")
    return closed.agg(F.coalesce(F.sum(F.size(F.array_intersect("later", "own"))), F.lit(0)).cast("long").alias("triangles"))


def statistics(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density, mean degree, transitivity: one row."""
    d = degree(edges)
    nodes = d.agg(F.count("*").alias("n_nodes"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    m = edges.agg(F.count("*").alias("n_edges"))
    df = nodes.crossJoin(m).crossJoin(triangles(edges))
    n = F.col("n_nodes")
    return df.select("n_nodes", "n_edges", (2 * F.col("n_edges") / (n * (n - 1))).alias("density"), (2 * F.col("n_edges") / n).alias("mean_degree"), F.when(F.col("triples") > 0, 3 * F.col("triangles") / F.col("triples")).otherwise(0.0).alias("transitivity"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Sum over groups of the share of inner edges less the squared share of degrees. partition: node, group."""
    m = edges.count()
    at = lambda side: partition.select(F.col("node").alias(side), F.col("group").alias(f"{side}_g"))
    inner = edges.join(at("source"), "source").join(at("target"), "target").filter("source_g = target_g").groupBy(F.col("source_g").alias("group")).agg(F.count("*").alias("inside"))
    total = degree(edges).join(partition, "node").groupBy("group").agg(F.sum("degree").alias("d"))
    return total.join(inner, "group", "left").agg(F.sum(F.coalesce("inside", F.lit(0)) / F.lit(m) - (F.col("d") / (2.0 * m)) ** 2).alias("modularity"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def chains(edges: DataFrame) -> DataFrame:
    """node, chain: maximal paths of nodes with degree two (at least two of them)."""
    two = degree(edges).filter("degree = 2")
    found = components(induced(edges, two))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").filter("size >= 2").select("node", F.col("component").alias("chain"))


def _met(rows: int, pieces: list[Piece], held: dict, sources: int) -> np.ndarray:
    """For each source and row the sum over its entries of what their columns sent."""
    got = np.zeros((sources, rows))
    for j, r, c, _ in pieces:
        if sent := held[j]["sent"]:
            x = np.frombuffer(sent, np.float64).reshape(sources, -1)
            some = (x != 0).any(axis=0)[c]
            at, column = r[some], c[some]
            for s in range(sources):
                got[s] += np.bincount(at, weights=x[s][column], minlength=rows)
    return got


def _sending(what: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Adds to a block's depth, paths and share what it sends; nothing if that is 0 throughout."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                depth, paths, share = (np.frombuffer(one.column(c)[0].as_buffer(), kind) for c, kind in (("depth", np.int32), ("paths", np.float64), ("share", np.float64)))
                x = what(depth, paths, share)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("i", "depth", "paths", "share")], pa.array([x.tobytes() if x.any() else b""], pa.binary())], names=["i", "depth", "paths", "share", "sent"])

    return send


def betweenness(edges: DataFrame, sample: int = 200, most: int = 1 << 22) -> DataFrame:
    """node, betweenness: shares of shortest paths that pass a node, from the first `sample` nodes, scaled to all pairs.

    Searches from many sources go level by level at once and count paths; shares flow back the same way. A block of
    nodes that a search has reached has an array of its sources' depths, paths and shares; so many sources go at once
    that what a task gets from all blocks it needs is at most `most` numbers. The number of jobs for each group of
    sources is four times the longest of the shortest paths.
    """
    blocks = Blocks(edges)
    n, k = blocks.n, min(sample, blocks.n)
    if blocks.empty:
        return blocks.nodes.select("node", F.lit(0.0).alias("betweenness"))
    size, schema = blocks.size, "i int, depth binary, paths binary, share binary, fresh long"
    found = blocks.nodes.select("number", F.lit(0.0).alias("x")).limit(0)
    needed = blocks.needs.groupBy("i").count().agg(F.max("count")).head()[0]
    for low in range(0, k, group := max(1, min(k, most // (size * needed)))):
        # Sources are the least nodes, and so the least numbers.
        high = min(k, low + group)
        width = high - low

        def begin(batches: Iterator[pa.RecordBatch], low=low, high=high, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("i").to_pylist():
                    rows = min(size, n - i * size)
                    depth, paths = np.full((width, rows), -1, np.int32), np.zeros((width, rows))
                    for x in range(max(low, i * size), min(high, i * size + rows)):
                        depth[x - low, x - i * size], paths[x - low, x - i * size] = 0, 1.0
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (depth, paths, np.zeros((width, rows)))]], names=["i", "depth", "paths", "share"])

        held_by = edges.sparkSession.range(low // size, (high - 1) // size + 1).select(F.col("id").cast("int").alias("i"))
        state, far = cut(held_by.mapInArrow(begin, "i int, depth binary, paths binary, share binary")), 0
        sending = "i int, depth binary, paths binary, share binary, sent binary"
        while True:

            def reach(i: int, rows: int, pieces: list[Piece], held: dict, far=far, width=width) -> dict:
                got = _met(rows, pieces, held, width)
                if i in held:
                    depth, paths, share = (np.frombuffer(held[i][c], kind).reshape(width, rows).copy() for c, kind in (("depth", np.int32), ("paths", np.float64), ("share", np.float64)))
                else:
                    depth, paths, share = np.full((width, rows), -1, np.int32), np.zeros((width, rows)), np.zeros((width, rows))
                fresh = (depth < 0) & (got > 0)
                if i not in held and not fresh.any():
                    return {"i": [], "depth": [], "paths": [], "share": [], "fresh": []}
                depth[fresh], paths[fresh] = far + 1, got[fresh]
                return {"i": [i], "depth": [depth.tobytes()], "paths": [paths.tobytes()], "share": [share.tobytes()], "fresh": [int(fresh.sum())]}

            ready = state.select("i", "depth", "paths", "share").mapInArrow(_sending(lambda depth, paths, share, far=far: np.where(depth == far, paths, 0.0)), sending)
            after = cut(blocks.step(ready, reach, schema, ["sent"], ["depth", "paths", "share"]))
            remove(state)
            state = after
            if not state.agg(F.sum("fresh")).head()[0]:
                break
            far += 1
        for level in range(far - 1, 0, -1):

            def flow(i: int, rows: int, pieces: list[Piece], held: dict, level=level, width=width) -> dict:
                if i not in held:
                    return {"i": [], "depth": [], "paths": [], "share": [], "fresh": []}
                depth, paths, share = (np.frombuffer(held[i][c], kind).reshape(width, rows) for c, kind in (("depth", np.int32), ("paths", np.float64), ("share", np.float64)))
                share = np.where(depth == level, paths * _met(rows, pieces, held, width), share)
                return {"i": [i], "depth": [held[i]["depth"]], "paths": [held[i]["paths"]], "share": [share.tobytes()], "fresh": [0]}

            ready = state.select("i", "depth", "paths", "share").mapInArrow(_sending(lambda depth, paths, share, level=level: np.where(depth == level + 1, (1 + share) / np.where(paths > 0, paths, 1.0), 0.0)), sending)
            after = cut(blocks.step(ready, flow, schema, ["sent"], ["depth", "paths", "share"]))
            remove(state)
            state = after

        def total(batches: Iterator[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, share in zip(batch.column("i"), batch.column("share"), strict=True):
                    x = np.frombuffer(share.as_buffer(), np.float64).reshape(width, -1).sum(axis=0)
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array(at + i.as_py() * size, pa.int64()), pa.array(x[at])], names=["number", "x"])

        found = found.union(cut(state.select("i", "share").mapInArrow(total, "number long, x double")))
        remove(state)
    scale = n / (k * (n - 1) * (n - 2)) if n > 2 else 0.0
    sums = found.groupBy("number").agg(F.sum("x").alias("x"))
    done = cut(blocks.nodes.join(sums, "number", "left").select("node", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness")))
    blocks.remove()
    return done


def group_diameters(edges: DataFrame, groups: DataFrame, most: int = 1 << 20) -> DataFrame:
    """group, diameter: the longest shortest path between two members of each group, by searches from every member. groups: node, group.

    Members start in batches, as many of each group at once as make `most` numbers for a block of nodes with a group.
    A node has a row for each group that has reached it, in which every start is a bit; a block's rows are a matrix.
    """
    blocks = Blocks(edges)
    names = cut(ranked(groups.select("group").distinct(), "group").select("group", (F.col("place") - 1).cast("long").alias("g")))
    if blocks.empty:
        return names.select("group", F.lit(0).alias("diameter"))
    codes, size = max(1, names.count()), blocks.size
    placed = cut(ranked(groups.join(blocks.nodes, "node").join(names, "group").select("g", "number").distinct(), "g", "number"))
    firsts = placed.groupBy("g").agg(F.min("place").alias("_first"))
    members = placed.join(firsts, "g").select(F.floor(F.col("number") / size).cast("int").alias("i"), ((F.col("number") % size) * codes + F.col("g")).alias("code"), (F.col("place") - F.col("_first")).cast("long").alias("p"))
    members = cut(members)
    large = (members.agg(F.max("p")).head()[0] or 0) + 1
    words = max(1, min(-(-large // 64), most // size))
    schema = "i int, code binary, seen binary, fresh binary, last binary, n long"
    names_ = [c.split()[0] for c in schema.split(", ")]

    def made(i: int, code: np.ndarray, seen: np.ndarray, fresh: np.ndarray, last: np.ndarray) -> dict:
        return {"i": [i], "code": [code.tobytes()], "seen": [seen.tobytes()], "fresh": [fresh.tobytes()], "last": [last.tobytes()], "n": [int(fresh.any(axis=1).sum())]}

    found = names.select("g", F.lit(0).alias("far")).limit(0)
    for low in range(0, large, 64 * words):

        def begin(table: pa.Table) -> pa.Table:  # noqa: B023
            code, p = table.column("code").to_numpy(), table.column("p").to_numpy()
            order = np.argsort(code)
            code, p = code[order], p[order] - low
            bits = np.zeros((len(code), words), np.uint64)
            at = np.flatnonzero((p >= 0) & (p < 64 * words))
            bits[at, p[at] // 64] = np.uint64(1) << (p[at] % 64).astype(np.uint64)
            # All members are rows from the start, whether searches start there or not.
            one = made(table.column("i")[0].as_py(), code, bits, bits, np.zeros(len(code), np.int32))
            return pa.table([pa.array(one["i"], pa.int32()), *[pa.array(one[c], pa.binary()) for c in names_[1:-1]], pa.array(one["n"], pa.int64())], names=names_)

        state, far = cut(members.groupBy("i").applyInArrow(begin, schema)), 0
        while True:
            far += 1

            def reach(i: int, rows: int, pieces: list[Piece], held: dict, far=far) -> dict:
                own = held.get(i)
                old, last = (np.frombuffer(own[c], kind) if own else np.zeros(0, kind) for c, kind in (("code", np.int64), ("last", np.int32)))
                before = np.frombuffer(own["seen"] if own else b"", np.uint64).reshape(-1, words)

                def meetings() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                    """Codes that entries reach (ascending), the rows of bits they bring, and these."""
                    for j, r, c, _ in pieces:
                        sent, fresh = np.frombuffer(held[j]["code"], np.int64), np.frombuffer(held[j]["fresh"], np.uint64).reshape(-1, words)
                        place = np.flatnonzero(fresh.any(axis=1))
                        # One group of each node at a time.
                        while len(place):
                            at = sent[place] // codes
                            first = np.concatenate(([True], at[1:] != at[:-1]))
                            of = np.full(int(max(at[-1], c.max())) + 1, -1, np.int32)
                            of[at[first]] = place[first]
                            hit = np.flatnonzero(of[c] >= 0)
                            with_ = of[c[hit]]
                            key = r[hit].astype(np.int64) * codes + sent[with_] % codes
                            if codes > 1:
                                order = np.argsort(key, kind="stable")
                                key, with_ = key[order], with_[order]
                            if len(key):
                                yield key, with_, fresh
                            place = place[~first]

                starts = lambda key: np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                every = old
                for key, _, _ in meetings():
                    every = np.union1d(every, key[starts(key)])
                if not len(every):
                    return {c: [] for c in names_}
                fresh, seen, late = np.zeros((len(every), words), np.uint64), np.zeros((len(every), words), np.uint64), np.full(len(every), -1, np.int32)
                step = max(1, (1 << 20) // words)
                for key, with_, sent in meetings():
                    first = starts(key)
                    for row, s, e in zip(np.searchsorted(every, key[first]), first, [*first[1:], len(key)], strict=True):
                        for k in range(s, e, step):
                            fresh[row] |= np.bitwise_or.reduce(sent[with_[k : min(e, k + step)]], axis=0)
                place = np.searchsorted(every, old)
                seen[place], late[place] = before, last
                fresh &= ~seen
                seen |= fresh
                # Members of a group keep the last level that reached them.
                late[(late >= 0) & fresh.any(axis=1)] = far
                return made(i, every, seen, fresh, late)

            after = cut(blocks.step(state, reach, schema, ["code", "fresh"], ["seen", "last"]))
            remove(state)
            state = after
            if not state.agg(F.sum("n")).head()[0]:
                break

        def ends_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for code, last in zip(batch.column("code"), batch.column("last"), strict=True):
                    g, late = np.frombuffer(code.as_buffer(), np.int64) % codes, np.frombuffer(last.as_buffer(), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(g[late >= 0]), pa.array(late[late >= 0])], names=["g", "far"])

        longest = cut(found.union(state.select("code", "last").mapInArrow(ends_, "g long, far int")).groupBy("g").agg(F.max("far").alias("far")))
        remove(state)
        if low:
            remove(found)
        found = longest
    done = cut(names.join(found, "g", "left").select("group", F.coalesce("far", F.lit(0)).alias("diameter")))
    for old in (found, members, placed, names):
        remove(old)
    blocks.remove()
    return done


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community: each node takes the label most of its neighbours have, the least on a tie; a fixed number of rounds."""
    blocks = Blocks(edges.select("source", "target"), how="sum")
    if blocks.empty:
        return blocks.nodes.select("node", F.col("node").alias("community"))
    n = blocks.n

    def vote(i: int, rows: int, pieces: list[Piece], held: dict) -> dict:
        # A code of row and label for each entry; equal ones are votes for the same.
        code = np.concatenate([r.astype(np.int64) * n + np.frombuffer(held[j]["label"], np.int64)[c] for j, r, c, _ in pieces])
        if all(w is None for _, _, _, w in pieces):
            code.sort()
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            votes = np.diff(np.append(first, len(code)))
        else:
            order = np.argsort(code, kind="stable")
            votes = np.concatenate([np.ones(len(r)) if w is None else w for _, r, _, w in pieces])[order]
            code = code[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            votes = np.add.reduceat(votes, first)
        row, label = code[first] // n, code[first] % n
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        most = np.maximum.reduceat(votes, start)
        best = np.minimum.reduceat(np.where(votes == np.repeat(most, np.diff(np.append(start, len(row)))), label, n), start)
        after = np.frombuffer(held[i]["label"], np.int64).copy()
        after[row[start]] = best
        return {"i": [i], "label": [after.tobytes()]}

    # Numbers are in the order of nodes, so the least number is the least label.
    labels = cut(blocks.state(blocks.nodes.select("number", F.col("number").alias("label")), label="i8"))
    for _ in range(rounds):
        after = cut(blocks.step(labels, vote, "i int, label binary", ["label"]))
        remove(labels)
        labels = after
    names = blocks.nodes.select(F.col("number").alias("label"), F.col("node").alias("community"))
    found = cut(blocks.nodes.join(blocks.rows(labels, label="i8"), "number").join(names, "label").select("node", "community"))
    remove(labels)
    blocks.remove()
    return found


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 1_000) -> DataFrame:
    """node, centrality by power iteration on A + I, scaled to length 1 each round, until no value changes by more than the tolerance.

    An error is raised if that takes more rounds than given.
    """
    blocks = Blocks(edges)
    if blocks.empty:
        return blocks.nodes.select("node", F.lit(0.0).alias("centrality"))

    state, length = cut(blocks.state(blocks.nodes.select("number", F.lit(1.0).alias("y")), y="f8").withColumn("x", F.lit(None).cast("binary"))), 1.0
    for round_ in range(rounds + 1):

        def moved(i: int, rows: int, pieces: list[Piece], held: dict, length=length) -> dict:
            x = np.frombuffer(held[i]["y"], np.float64) / length
            y = x + summed(rows, pieces, held, "y") / length
            change = float(np.abs(x - np.frombuffer(held[i]["x"], np.float64)).max()) if held[i]["x"] else None
            return {"i": [i], "y": [y.tobytes()], "x": [x.tobytes()], "square": [float(y @ y)], "change": [change]}

        # A round also sees how much the one before it changed.
        after = cut(blocks.step(state, moved, "i int, y binary, x binary, square double, change double", ["y"], ["x"]))
        remove(state)
        state = after
        square, change = state.agg(F.sum("square"), F.max("change")).head()
        if round_ and change <= tolerance:
            found = cut(blocks.nodes.join(blocks.rows(state, x="f8"), "number").select("node", F.col("x").alias("centrality")))
            remove(state)
            blocks.remove()
            return found
        length = float(np.sqrt(square))
    raise RuntimeError("the centralities have not settled")
