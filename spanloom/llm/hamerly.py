"""Exact k-means over integer vectors with Hamerly's two bounds for each vector.

A table in the shared folder keeps for each vector its cluster, an upper bound of the distance to the cluster's
centroid and one lower bound of the distance to any other. When centroids move, the upper bound grows by the drift of
the vector's own centroid and the lower one shrinks by the largest drift of the others. A vector whose upper bound
stays below the lower one, or below half the way from its centroid to the nearest other one, keeps its cluster without
a look at its components. For the others the upper bound is first made exact, and those that are still ambiguous get
a full scan of exact integer distances, in which the smaller number wins a tie. Bounds are floating point and are
compared with a margin far above their rounding, so a tie is never decided by a bound.

Each task sums the vectors of each cluster; of these sums as many numbers as the centroids have meet on the driver.
Vectors are never shuffled, so neither a large cluster nor a vector that occurs often makes a large task. A round's
table replaces the one before.

Defined cases: null vectors, those of another width and those with a null or non-finite component are left out; a null
id never starts a centroid before one that is none; rows that repeat an id are vectors of their own; with fewer
vectors than centroids there are fewer centroids; empty tables give empty results; other columns are ignored. A
component beyond 2^27 after scaling is an error, since squared distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common

WIDTH, SCALE, CENTRES, ROUNDS = 64, 1024, 8, 10
LARGEST = 1 << 27
#: Far above the rounding of a dozen additions of square roots, and far below the distance of different integer vectors that matter.
MARGIN = 1e-9


def integer_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of int): floor(scale * x) of the vectors with `width` components, all finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    whole = lambda a: F.when(F.abs(a * scale) < LARGEST, F.floor(a * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("int"))
    kept = vectors.filter((F.size("embedding") == width) & F.coalesce(fine, F.lit(False)))
    return kept.select("vec_id", F.transform(x, whole).alias("v"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and id; of equal ids the smaller vector."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector."""
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def scan(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on a tie), its distance and that of the second nearest."""
    d = squared(v, centres)
    near = d.argmin(axis=1)
    own = np.take_along_axis(d, near[:, None], axis=1)[:, 0]
    np.put_along_axis(d, near[:, None], np.iinfo(np.int64).max, axis=1)
    second = np.sqrt(d.min(axis=1)) if len(centres) > 1 else np.full(len(v), np.inf)
    return near, np.sqrt(own), second


def assigned(points: DataFrame, centres: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """vec_id, v, cluster, upper, lower by the given centroids. Without a drift, or with no cluster yet, all are scanned."""
    width = centres.shape[1]
    gaps = np.sqrt(squared(centres, centres).astype(float))
    np.fill_diagonal(gaps, np.inf)
    half = gaps.min(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            v = matrix(batch, width)
            if drift is None:
                near, upper, lower = scan(v, centres)
            else:
                near, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(drift))])
                upper, lower = upper + drift[near], lower - others[near]
                bar = np.maximum(half[near], lower) * (1 - MARGIN)
                loose = np.flatnonzero(upper * (1 + MARGIN) + MARGIN >= bar)
                upper[loose] = np.sqrt(((v[loose] - centres[near[loose]]) ** 2).sum(axis=1))
                ambiguous = loose[upper[loose] * (1 + MARGIN) + MARGIN >= bar[loose]]
                near[ambiguous], upper[ambiguous], lower[ambiguous] = scan(v[ambiguous], centres)
            yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": near.astype(np.int32), "upper": upper, "lower": lower}

    kind = points.schema["vec_id"].dataType.simpleString()
    return common.arrow_map(points, run, f"vec_id {kind}, v array<int>, cluster int, upper double, lower double", 4096)


def sums(points: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each cluster has, and their exact sums: k * (width + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            near = batch.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(total, near, np.column_stack([np.ones(len(near), np.int64), matrix(batch, width)]))
        yield {"cluster": np.repeat(np.arange(k, dtype=np.int32), width + 1), "i": np.tile(np.arange(width + 1, dtype=np.int32), k), "x": total.ravel()}

    out = np.zeros((k, width + 1), object)
    for r in common.arrow_map(points.select("v", "cluster"), run, "cluster int, i int, x long", 4096).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():
        out[r["cluster"], r["i"]] = r["x"]
    return out[:, 0], out[:, 1:]


def clustered(points: DataFrame, k: int = CENTRES, rounds: int = ROUNDS, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (exact, squared) after so many rounds, and the centroids. points: vec_id, v (array of int)."""
    spark, kind = points.sparkSession, points.schema["vec_id"].dataType.simpleString()
    points, first = common.written(points, "points")
    centres = first_centroids(points, k, salt)
    schema = f"vec_id {kind}, cluster int, distance long"
    if not len(centres):
        return spark.createDataFrame([], schema), centres
    width = centres.shape[1]
    now, path = common.written(assigned(points, centres, None), "bounds")
    common.remove(spark, first)
    for _ in range(rounds):
        counts, totals = sums(now, len(centres), width)
        moved = np.array([[x // n for x in row] if n else old for n, row, old in zip(counts, totals, centres.tolist())], np.int64)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        centres = moved
        if not drift.any():  # all further rounds would find the same
            break
        after, new = common.written(assigned(now, centres, drift), "bounds")
        common.remove(spark, path)
        now, path = after, new

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            near = batch.column("cluster")
            yield {"vec_id": batch.column("vec_id"), "cluster": near, "distance": ((matrix(batch, width) - centres[near.to_numpy(zero_copy_only=False)]) ** 2).sum(axis=1)}

    found, _ = common.written(common.arrow_map(now.select("vec_id", "v", "cluster"), distances, schema, 4096), "clusters")
    common.remove(spark, path)
    return found, centres


def with_inertia(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256. What is broadcast has a row for each centroid."""
    spark = found.sparkSession
    by = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres.tolist()) if c in by]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_hamerly(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(integer_vectors(common.table(spark, sf_dir, "embeddings"))))


def oracle(k: int = CENTRES, rounds: int = ROUNDS) -> str:
    """Lloyd's rounds without bounds, a few materialised tables for each round."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS w FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS dist FROM kept, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min_by(c, dist * {k} + c) AS c, CAST(min(dist) AS BIGINT) AS dist FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) u GROUP BY c, i)")
            steps.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.w, o.w) AS w FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)")
    last = f"SELECT a.vec_id, a.c AS cluster, a.dist AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"
    return "WITH " + ",\n".join(steps) + "\n" + last


OP13_SQL = oracle()
