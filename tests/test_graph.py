"""Communities, spectra, searches and quantiles against plain versions."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import community, graph, spectra
from spanloom.operators.blocks import Blocks
from spanloom.plans import catalog
from spanloom.plans.tables import cut, quantile


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables in many rounds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def planted(groups, size, rng, inside=0.7):
    edges = set()
    for g in range(groups):
        nodes = range(g * size, (g + 1) * size)
        edges |= {(a, b) for a in nodes for b in nodes if a < b and rng.random() < inside}
    return sorted(edges | {(g * size, (g + 1) * size) for g in range(groups - 1)})


def modularity(edges, c):
    total, degree, inside = 0.0, {}, 0.0
    for a, b, w in edges:
        total += w
        degree[a] = degree.get(a, 0.0) + w
        degree[b] = degree.get(b, 0.0) + w
        inside += w * (c[a] == c[b])
    sums = {}
    for k, d in degree.items():
        sums[c[k]] = sums.get(c[k], 0.0) + d
    return inside / total - sum((d / (2 * total)) ** 2 for d in sums.values())


def louvain(edges):
    """One node at a time, level by level: the plain form."""
    links = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {})
            links[x][y] = links[x].get(y, 0.0) + w
    names = {x: x for x in links}
    m2 = sum(sum(n.values()) for n in links.values())
    while True:
        k = {x: sum(n.values()) for x, n in links.items()}
        c, sigma, rose = {x: x for x in links}, dict(k), True
        changed = False
        while rose:
            rose = False
            for x in sorted(links):
                near = {c[x]: 0.0}
                for y, w in links[x].items():
                    if y != x:
                        near[c[y]] = near.get(c[y], 0.0) + w
                sigma[c[x]] -= k[x]
                best = max(near, key=lambda g: (near[g] - k[x] * sigma[g] / m2, g == c[x]))
                if near[best] - k[x] * sigma[best] / m2 > near[c[x]] - k[x] * sigma[c[x]] / m2 + 1e-12:
                    c[x], rose, changed = best, True, True
                sigma[c[x]] += k[x]
        if not changed:
            return names
        names = {x: c[g] for x, g in names.items()}
        merged = {}
        for x, n in links.items():
            for y, w in n.items():
                merged.setdefault(c[x], {})
                merged[c[x]][c[y]] = merged[c[x]].get(c[y], 0.0) + w
        links = merged


def given(spark):
    """Co-occurrences of the smallest tables with their weights."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    return graph.cooccurrence(lines, "l_orderkey", "l_partkey").orderBy("source", "target")


def rings():
    """Thirty cliques of five in a ring: single nodes cannot leave a clique, so that only a second level joins cliques."""
    edges = [(g * 5 + a, g * 5 + b) for g in range(30) for a in range(5) for b in range(a)]
    return [(min(e), max(e), 1) for e in edges + [(g * 5, (g * 5 + 6) % 150) for g in range(30)]]


@pytest.mark.parametrize("kind", ["rings", "weighted"])
def test_communities(spark, kind):
    rng = np.random.default_rng(4)
    edges = rings() if kind == "rings" else [(a, b, 1 + int(rng.integers(0, 9))) for a, b in planted(5, 12, rng)]
    df = spark.createDataFrame(edges, "source long, target long, weight long")
    found = {r.node: r.community for r in community.communities(df).collect()}
    assert set(found) == {x for e in edges for x in e[:2]}
    assert all(min(k for k in found if found[k] == g) == g for g in set(found.values()))
    assert modularity(edges, found) >= modularity(edges, louvain(edges)) - 0.005
    if kind == "rings":
        assert len(set(found.values())) < 30


def test_communities_of_odd_graphs(spark):
    assert community.communities(spark.createDataFrame([], "source long, target long")).count() == 0
    found = {r.node: r.community for r in community.communities(spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_levels_of_communities_over_many_blocks(spark, monkeypatch):
    """Modularity as the passes weigh it is that of the labels, here and on the contracted graph; edges are not shuffled by turns."""
    rng = np.random.default_rng(6)
    edges = [(a, b, 1 + int(rng.integers(0, 4))) for a, b in planted(3, 10, rng)] + [(3, 3, 2)]
    df = spark.createDataFrame(edges, "source long, target long, weight long")
    over = Blocks(df, how="sum", weight="weight", entries=30)
    assert len(over) > 3
    written, whole = [], community.cut
    monkeypatch.setattr(community, "cut", lambda x: written.append(x.columns) or whole(x))
    state, first, last = community.settled(over)
    assert not any({"source", "target"} <= set(c) or {"a", "b"} <= set(c) for c in written)
    labels = {r.number: r.label for r in over.rows(state, label="i8").collect()}
    assert last == pytest.approx(modularity(edges, labels)) and last > first
    links = community.contracted(over, state)
    pairs = [tuple(r) for r in links.collect()]
    assert sum(w for _, _, w in pairs) == pytest.approx(sum(w for _, _, w in edges))
    assert modularity(pairs, {x: x for e in pairs for x in e[:2]}) == pytest.approx(last)


def test_spectral_gap(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(10, 11)], "source long, target long")
    assert spectra.spectral_gap(path) == pytest.approx(0.0, abs=1e-7)  # two components
    ring = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(0, 5)], "source long, target long")
    assert spectra.spectral_gap(ring) == pytest.approx(1 - np.cos(2 * np.pi / 6))
    assert spectra.spectral_gap(spark.createDataFrame([(1, 2)], "source long, target long")) == 0.0


def test_spectral_gap_of_weighted_edges(spark):
    df = given(spark).limit(600)
    edges = df.collect()
    number = {x: k for k, x in enumerate(sorted({x for e in edges for x in e[:2]}))}
    # One component, so that the gap is not 0.
    edges = [(number[a], number[b], w) for a, b, w in edges] + [(0, k, 1) for k in range(1, len(number)) if (0, k) not in {(number[a], number[b]) for a, b, _ in edges}]
    a = np.zeros((len(number), len(number)))
    for x, y, w in edges:
        a[x, y] += w
        a[y, x] += w
    root = np.sqrt(a.sum(axis=1))
    values = np.linalg.eigvalsh(np.eye(len(a)) - a / root[:, None] / root[None, :])
    assert spectra.spectral_gap(spark.createDataFrame(edges, "source long, target long, weight long")) == pytest.approx(values[1] - values[0], abs=1e-6)


def test_spectral_gap_without_steps(spark, monkeypatch):
    """Several components take no step, and a graph of one block takes them in one task; over several blocks the value is the same."""
    rng = np.random.default_rng(8)
    edges = planted(3, 12, rng)
    df = spark.createDataFrame(edges, "source long, target long")
    apart = df.union(df.selectExpr("source + 1000", "target + 1000"))
    a = np.zeros((36, 36))
    for x, y in edges:
        a[x, y] = a[y, x] = 1.0
    root = np.sqrt(a.sum(axis=1))
    want = np.linalg.eigvalsh(np.eye(36) - a / root[:, None] / root[None, :])[1]
    over = functools.partial(Blocks, entries=100)
    made = []
    monkeypatch.setattr(spectra, "Blocks", lambda *x, **k: made.append(over(*x, **k)) or made[-1])
    assert spectra.spectral_gap(df, whole=0) == pytest.approx(want, abs=1e-6)
    assert len(made[-1]) > 1
    steps, whole_step = [], Blocks.step
    monkeypatch.setattr(Blocks, "step", lambda self, state, kernel, schema, *rest: steps.append(schema) or whole_step(self, state, kernel, schema, *rest))
    assert spectra.spectral_gap(df) == pytest.approx(want, abs=1e-6)
    assert len(made[-1]) == 1 and sum("label" not in s for s in steps) == 1
    steps.clear()
    assert spectra.spectral_gap(apart, whole=0) == 0.0
    assert all("label" in s for s in steps)


def test_diameters(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(10, 11)], "source long, target long")
    groups = spark.createDataFrame([(k, "a") for k in range(6)] + [(10, "b"), (11, "b"), (99, "c")], "node long, group string")
    assert {r.group: r.diameter for r in graph.group_diameters(path, groups).collect()} == {"a": 5, "b": 1, "c": 0}


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_diameters_are_of_all_members(spark, most):
    """The farthest members have the largest ids, over several batches of starts; groups may share nodes."""
    edges = [(a, b) for a in range(70) for b in range(a + 1, 70) if (a * b) % 3 == 0] + [(5, 100), *[(k, k + 1) for k in range(100, 104)], (7, 200), *[(k, k + 1) for k in range(200, 203)]]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def far(start):
        got, level = {start: 0}, [start]
        while level:
            level = [w for v in level for w in near[v] if w not in got and not got.update({w: got[v] + 1})]
        return got

    groups = {"all": sorted(near), "ends": [104, 203], "some": list(range(40, 70))}
    want = {g: max(far(a).get(b, 0) for a in nodes for b in nodes) for g, nodes in groups.items()}
    df = spark.createDataFrame([(n, g) for g, nodes in groups.items() for n in nodes], "node long, group string")
    assert {r.group: r.diameter for r in graph.group_diameters(spark.createDataFrame(edges, "source long, target long"), df, most=most).collect()} == want
    assert want["all"] > 4


def test_long_paths(spark):
    """Searches go on to the end of a path, beyond any fixed number of rounds."""
    path = spark.createDataFrame([(k, k + 1) for k in range(39)], "source long, target long")
    ends = spark.createDataFrame([(0, "ends"), (39, "ends")], "node long, group string")
    assert {r.group: r.diameter for r in graph.group_diameters(path, ends).collect()} == {"ends": 39}


def plain_betweenness(edges, sources):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        far, paths, order = {s: 0}, dict.fromkeys(near, 0.0), [s]
        paths[s] = 1.0
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n, k = len(near), len(sources)
    return {v: x * n / (k * (n - 1) * (n - 2)) for v, x in total.items()}


@pytest.mark.parametrize("sample", [200, 7])
def test_betweenness_against_a_plain_version(spark, sample):
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (6, 7), (20, 21), (21, 22)]
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "source long, target long"), sample).collect()}
    nodes = sorted({x for e in edges for x in e})
    assert found == pytest.approx(plain_betweenness(edges, nodes[:sample]))


def test_eigenvector(spark):
    rng = np.random.default_rng(1)
    edges = planted(3, 8, rng)
    a = np.zeros((24, 24))
    for x, y in edges:
        a[x, y] = a[y, x] = 1.0
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    found = {r.node: r.centrality for r in graph.eigenvector(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert [found[k] for k in range(24)] == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_quantile(spark, bins):
    rng = random.Random(bins)
    for values in ([1.0], [3.0, 3.0, 3.0], [0.0, 1.0], [rng.choice((0.0, 1e-9, 5.0, rng.random())) for _ in range(200)]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        for share in (0.0, 0.25, 0.5, 0.93, 1.0):
            assert quantile(df, "x", share, bins) == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_label_propagation(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (6, 7)]
    sides = {}
    for a, b in edges:
        sides.setdefault(a, []).append(b)
        sides.setdefault(b, []).append(a)
    labels = {n: n for n in sides}
    for _ in range(5):
        votes = {n: [labels[o] for o in others] for n, others in sides.items()}
        labels = {n: min(set(v), key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
    found = graph.label_propagation(spark.createDataFrame(edges, "source long, target long")).collect()
    assert {r.node: r.community for r in found} == labels


def test_triangles_make_no_row_for_each_path(spark):
    rng = np.random.default_rng(5)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (300, 2)).tolist() if a != b}
    plain = sum((a, c) in pairs and (b, c) in pairs for a, b in pairs for c in range(b + 1, 40))
    df = graph.triangles(spark.createDataFrame(sorted(pairs), "source long, target long"))
    assert df.collect() == [(plain,)]
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()
    assert graph.triangles(spark.createDataFrame([(1, 2)], "source long, target long")).collect() == [(0,)]


def test_importance_and_what_a_percentile_writes(spark, monkeypatch):
    edges = cut(spark.createDataFrame([(1, 2, 3), (2, 3, 1), (3, 4, 2)], "source long, target long, weight long"))
    members = cut(spark.createDataFrame([(k, 1, "C0001") for k in (1, 2, 3, 4)], "node long, component long, compound_id string"))
    z = cut(spark.createDataFrame([(1, 0.5, "a"), (2, 0.5, "a"), (3, 1.5, "b"), (4, -1.0, "b")], "node long, z double, root string"))
    found = graph.with_importance(edges, members, z)
    rows = {(r.source, r.target): r.importance for r in found.collect()}
    assert rows[1, 2] == 1.0 and min(rows.values()) == 0.0
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or cut(df))
    kept = graph.prune(found, F.col("importance"), 0.5, (F.col("source_z") > 5) & (F.col("target_z") > 5))
    # The edges are not written a second time.
    assert written and not any("source" in columns for columns in written)
    assert {(r.source, r.target) for r in kept.collect()} == {(1, 2), (3, 4)}


def test_rarity_joins_no_edges_by_compound(spark):
    """What is left of the plan after importance is a scan and a filter."""
    df = catalog.QUERIES["prune_rarity"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_betweenness_takes_few_sources_at_once(spark, monkeypatch):
    """Groups of sources are so small that what a task gets from all its blocks stays within `most` numbers."""
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (6, 7)]
    monkeypatch.setattr(graph, "Blocks", functools.partial(Blocks, entries=6))
    sent, whole = [], Blocks.step

    def step(self, state, *rest):
        found = state.selectExpr("max(length(depth)) AS x").head()[0] or 0
        sent.append(found // 4 * self.needs.groupBy("i").count().agg(F.max("count")).head()[0])
        return whole(self, state, *rest)

    monkeypatch.setattr(Blocks, "step", step)
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "source long, target long"), 6, 24).collect()}
    assert found == pytest.approx(plain_betweenness(edges, range(6)))
    assert max(sent) <= 24
