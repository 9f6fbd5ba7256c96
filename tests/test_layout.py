"""Forces by a pyramid of cells against the direct sum over all pairs; springs on a small grid."""

import numpy as np
import pytest

from spanloom.operators import layout


def table(spark, points):
    names = ["x", "y", "z"][: points.shape[1]]
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], ", ".join(["id long", *[f"{a} double" for a in names]]))


def direct(points, soft=1e-12):
    away = points[:, None] - points[None]
    return (away / ((away**2).sum(-1, keepdims=True) + soft)).sum(1)


def found(df, n, dims):
    rows = {r["id"]: [r[f"f{a}"] for a in "xyz"[:dims]] for r in df.collect()}
    assert len(rows) == n
    return np.array([rows[k] for k in range(n)])


def error(points, got):
    want = direct(points)
    return np.linalg.norm(got - want, axis=1).sum() / np.linalg.norm(want, axis=1).sum()


CASES = {
    "even": np.random.default_rng(1).random((700, 2)),
    "two heaps": np.concatenate([np.random.default_rng(2).normal(0, 0.01, (300, 2)), np.random.default_rng(3).normal(1, 0.2, (300, 2))]),
    "a line": np.stack([np.arange(200.0), np.zeros(200)], 1),
    "in space": np.random.default_rng(4).random((300, 3)),
}


@pytest.mark.parametrize("name", CASES)
def test_repulsion_is_near_the_direct_sum(spark, name):
    points = CASES[name]
    assert error(points, found(layout.repulsion(table(spark, points)), *points.shape)) < 0.05


def test_full_cells_act_as_a_whole(spark):
    # A few cells hold all: every node still meets all others' mass, at a larger error.
    points = np.random.default_rng(5).random((400, 2))
    exact = error(points, found(layout.repulsion(table(spark, points), depth=2, leaf=1_000), 400, 2))
    whole = error(points, found(layout.repulsion(table(spark, points), depth=2, leaf=4), 400, 2))
    assert exact < 0.1 and exact < whole < 0.6


def test_few_nodes_and_equal_places(spark):
    one = found(layout.repulsion(table(spark, np.array([[2.0, 3.0]]))), 1, 2)
    assert (one == 0).all()
    same = found(layout.repulsion(table(spark, np.ones((40, 2)))), 40, 2)
    assert np.abs(same).max() < 1e-6
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert layout.repulsion(empty).collect() == []
    assert layout.spring(empty, spark.createDataFrame([], "source long, target long, weight double")).collect() == []


def test_springs_bring_neighbours_together(spark):
    side = 6
    at = lambda r, c: r * side + c
    edges = [(at(r, c), at(r + a, c + b), 1.0) for r in range(side) for c in range(side) for a, b in ((0, 1), (1, 0)) if r + a < side and c + b < side]
    start = np.random.default_rng(6).random((side * side, 2))
    got = layout.spring(table(spark, start), spark.createDataFrame(edges, "source long, target long, weight double"), rounds=12).toPandas().sort_values("id")[["x", "y"]].to_numpy()

    def ratio(p):
        length = np.mean([np.linalg.norm(p[s] - p[t]) for s, t, _ in edges])
        return length / np.mean(np.linalg.norm(p[:, None] - p[None], axis=-1))

    assert len(got) == side * side and np.isfinite(got).all()
    assert ratio(got) < 0.75 * ratio(start)


def test_pull_along_edges(spark):
    points = np.array([[0.0, 0.0], [3.0, 4.0], [1.0, 0.0]])
    rows = layout.attraction(table(spark, points), spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 1, 9.0)], "source long, target long, weight double")).collect()
    assert {r["id"]: (r["fx"], r["fy"]) for r in rows} == {0: (31.0, 40.0), 1: (-30.0, -40.0), 2: (-1.0, 0.0)}
