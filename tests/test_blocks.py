"""Graphs as blocks against NumPy, with many blocks, loops and edges given twice."""

import inspect
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import blocks


@pytest.mark.parametrize("how", ["set", "sum"])
def test_a_step_over_many_blocks(spark, how):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(1, 5, 300), strict=True)]
    ids = sorted({x for e in edges for x in e[:2]})
    at = {x: k for k, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y, w in edges:
        for r, c in ((x, y), (y, x)):
            a[at[r], at[c]] = 1.0 if how == "set" else a[at[r], at[c]] + w
    graph = blocks.Blocks(spark.createDataFrame(edges, "source long, target long, weight double"), how, "weight", entries=100)
    assert len(graph) > 3
    state = graph.state(graph.nodes.selectExpr("number", "double(number) AS x"), x="f8")
    step = graph.step(state, lambda i, rows, pieces, held: {"i": [i], "x": [blocks.summed(rows, pieces, held, "x").tobytes()]}, "i int, x binary", ["x"])
    found = {r.number: r.x for r in graph.rows(step, x="f8").collect()}
    assert [found[k] for k in range(len(ids))] == pytest.approx((a @ np.arange(len(ids))).tolist())
    # The edges are not shuffled again: what a round sends is.
    assert step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") == 1
    graph.remove()


def test_what_a_full_block_of_rows_takes(spark):
    """Two workers of an executor of 3000 MB pack a block each."""
    entries = inspect.signature(blocks.Blocks).parameters["entries"].default
    size, rng = 1 << 14, np.random.default_rng(1)
    a, b = (rng.integers(0, size, entries).astype(np.int32) for _ in range(2))
    table = pa.table({"key": pa.array([0], pa.int64()), "i": pa.array([0], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()], "w": [b""]})
    tracemalloc.start()
    blocks._packed(size, False)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
