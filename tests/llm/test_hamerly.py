"""Clusters against plain rounds with Python's integers; ties, odd rows, empty tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import hamerly


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables in many rounds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(rows, k=8, rounds=10, width=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows, by Lloyd's rounds."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]) if r[0] is not None else (True, "", r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    final = [(i, *near(v)) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sum(e for _, e, m in final if m == j), sum(e for _, e, _ in final), sha[j]) for i, d, j in final), key=str)


def table(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "upper": F.lit(None).cast("double")}).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def found(spark, d):
    return sorted((tuple(r) for r in hamerly.op13_hamerly(spark, d).collect()), key=str)


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert found(spark, d) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_groups(spark, tmp_path, seed):
    """Few different coordinates, so that many distances tie, many equal vectors, and centroids that lose all vectors."""
    rng = random.Random(seed)
    vectors = [[rng.choice((-1.0, 0.0, 0.5)) if j < 2 + seed else 0.0 for j in range(64)] for _ in range(150)] + [[0.25] * 64] * 40
    rows = list(enumerate(vectors))
    assert found(spark, table(spark, rows, tmp_path)) == plain(rows)


def test_bounds_spare_scans(spark):
    """In later rounds most vectors of separate groups are not scanned, and no vector's bounds are wrong."""
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (8, 64))
    points = spark.createDataFrame([(i, (centres[i % 8] + rng.integers(-300, 300, 64)).tolist()) for i in range(400)], "vec_id long, v array<int>")
    state = spark.createDataFrame(hamerly.assigned(points, centres, None).collect(), "vec_id long, v array<int>, cluster int, upper double, lower double")
    moved = centres + rng.integers(-20, 20, centres.shape)
    drift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
    after = hamerly.assigned(state, moved, drift).collect()
    exact = hamerly.squared(np.array([r.v for r in after]), moved)
    assert [r.cluster for r in after] == exact.argmin(axis=1).tolist()
    own = np.sqrt(exact.min(axis=1))
    second = np.sqrt(np.sort(exact, axis=1)[:, 1])
    assert all(r.upper >= d - 1e-6 and r.lower <= s + 1e-6 for r, d, s in zip(after, own, second))
    # A bound that is only loosened lies above the distance; a scan would have made it exact.
    assert sum(r.upper > d + 1e-6 for r, d in zip(after, own)) > 350


def test_odd_and_empty_tables(spark, tmp_path):
    one = [0.5] * 64
    rows = [(1, None), (2, []), (3, one[:63]), (4, [*one, 1.0]), (5, [None, *one[1:]]), (6, [float("nan"), *one[1:]]), (7, [float("inf"), *one[1:]]), (None, one), (None, [1.5] * 64), (8, one), (8, one), (8, [-0.3] * 64), (9, [0.1] * 64), (10, [-0.0] * 64)]
    d = table(spark, rows, tmp_path / "odd")
    assert found(spark, d) == plain(rows) and len(found(spark, d)) == 7
    for name, some in (("none", []), ("kept_none", rows[:7])):
        assert found(spark, table(spark, some, tmp_path / name)) == []


def test_too_large_components(spark, tmp_path):
    d = table(spark, [(1, [1e30] + [0.0] * 63)], tmp_path)
    with pytest.raises(Exception, match="beyond 134217728"):
        found(spark, d)
