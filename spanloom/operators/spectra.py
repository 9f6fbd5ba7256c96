"""The spectral gap of a whole graph by Lanczos steps, with vectors as tables.

The normalised Laplacian I - N, N = D^-1/2 A D^-1/2, has the eigenvalue 0 with the known vector of square roots of
degrees. The gap to the next eigenvalue is 1 less the largest eigenvalue of N on what is orthogonal to that vector, and
Lanczos' three-term recurrence finds it: a step sends the vector's blocks to the blocks of rows that have edges there
(`blocks.Blocks`), makes one table of a row for each block (the last two vectors and the new product) and one row of
scalar products, which is all that the driver sees. The known vector is taken out of every product again, so rounding
does not bring it back. Steps end when the residual of the largest value's vector is under the tolerance; the value's
own error is about its square over the distance to the next. A graph of several components has the eigenvalue 0 once
for each, so its gap is 0 and takes no step; one of few edges is one block, whose task makes all steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.blocks import Blocks, Piece, summed
from spanloom.operators.graph import labels
from spanloom.plans.tables import cut, remove

VECTORS = ("u", "p", "q", "w")
PAIRS = [a + b for i, a in enumerate(VECTORS) for b in VECTORS[i:]]


def _read(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[c], np.float64) for c in names]


def _settled(alphas: list[float], betas: list[float], rest: float, tolerance: float) -> float | None:
    """The gap by the recurrence's numbers, if the residual of the largest value's vector is under the tolerance."""
    values, turns = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
    return float(min(max(1.0 - values[-1], 0.0), 2.0)) if rest * abs(turns[-1, -1]) < tolerance or rest < 1e-12 else None


def _alone(tolerance: float) -> Callable:
    """A kernel that makes all steps on a graph of one block."""

    def run(i: int, rows: int, pieces: list[Piece], held: dict) -> dict:
        degree, q = sum((np.bincount(r, weights=w, minlength=rows) for _, r, _, w in pieces), np.zeros(rows)), _read(held[i], "q")[0]
        total = degree.sum()
        u, p = np.sqrt(degree / total), np.zeros(rows)
        q = q - (u @ q) * u
        q /= np.sqrt(q @ q)
        alphas, betas, gap = [], [], None
        while gap is None:
            w = summed(rows, pieces, {i: {"s": q / u}}, "s") / u / total
            alphas.append(float(q @ w))
            w -= alphas[-1] * q + (betas[-1] if betas else 0.0) * p + (u @ w) * u
            rest = float(np.sqrt(w @ w))
            # The larger the matrix, the fewer steps look at its values.
            if rest < 1e-12 or len(alphas) % (1 + len(alphas) // 32) == 0:
                gap = _settled(alphas, betas, rest, tolerance)
            betas.append(rest)
            p, q = q, w / (rest or 1.0)
        return {"i": [i], "gap": [gap]}

    return run


def spectral_gap(edges: DataFrame, tolerance: float = 1e-5, whole: int = 1 << 22) -> float:
    """The second less the first eigenvalue of the normalised Laplacian; 0 under three nodes. edges: source, target, and weight if there is one."""
    blocks = Blocks(edges, how="sum", weight="weight" if "weight" in edges.columns else None, whole=whole)
    if blocks.n < 3:
        return 0.0
    near = labels(blocks)
    apart = not blocks.rows(near, label="i8").filter("label > 0").isEmpty()
    remove(near)
    if apart:
        blocks.remove()
        return 0.0

    def begun(i: int, rows: int, pieces: list[Piece], held: dict) -> dict:
        degree, draw = sum((np.bincount(r, weights=w, minlength=rows) for _, r, _, w in pieces), np.zeros(rows)), _read(held[i], "q")[0]
        root = np.sqrt(degree)
        return {"i": [i], "r": [root.tobytes()], "q": [draw.tobytes()], "total": [float(degree.sum())], "along": [float(root @ draw)], "square": [float(draw @ draw)]}

    # A start without symmetry: numbers in [-1, 1) from hashes, then without the known vector and of length 1.
    draw = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) / float(1 << 19) - 1.0
    drawn = blocks.state(blocks.nodes.select("number", draw.alias("q")), q="f8")
    if len(blocks) == 1:
        gap = blocks.step(drawn, _alone(tolerance), "i int, gap double", ["q"]).head()["gap"]
        blocks.remove()
        return gap
    first = cut(blocks.step(drawn, begun, "i int, r binary, q binary, total double, along double, square double", ["q"]))
    total, along, square = first.agg(F.sum("total"), F.sum("along"), F.sum("square")).head()
    root = float(np.sqrt(total))
    along /= root
    length = float(np.sqrt(square - along**2))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r, q = _read(row, "r", "q")
                u = r / root
                yield sent(row["i"], u, np.zeros(len(u)), (q - along * u) / length)

    def sent(i: int, u: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (u, p, q, q / u)]], names=["i", "u", "p", "q", "s"])

    def product(i: int, rows: int, pieces: list[Piece], held: dict) -> dict:
        u, p, q = _read(held[i], "u", "p", "q")
        v = {"u": u, "p": p, "q": q, "w": summed(rows, pieces, held, "s") / u / total}
        return {"i": [i], **{c: [v[c].tobytes()] for c in VECTORS}, **{c: [float(v[c[0]] @ v[c[1]])] for c in PAIRS}}

    state, before = first.select("i", "r", "q").mapInArrow(start, "i int, u binary, p binary, q binary, s binary"), first
    alphas, betas = [], []
    while True:
        now = cut(blocks.step(state, product, ", ".join(["i int", *[f"{c} binary" for c in VECTORS], *[f"{c} double" for c in PAIRS]]), ["s"], ["u", "p", "q"]))
        remove(before)
        before = now
        dots = now.agg(*[F.sum(c).alias(c) for c in PAIRS]).head().asDict()
        alpha, beta = dots["qw"] / dots["qq"], betas[-1] if betas else 0.0
        alphas.append(alpha)
        # The rest w - alpha q - beta p - gamma u, and its length from the scalar products.
        c = {"w": 1.0, "q": -alpha, "p": -beta, "u": -dots["uw"]}
        square = sum(c[a] * c[b] * dots[a + b] * (1 if a == b else 2) for i, a in enumerate(VECTORS) for b in VECTORS[i:])
        rest = float(np.sqrt(max(square, 0.0)))
        if (gap := _settled(alphas, betas, rest, tolerance)) is not None:
            remove(now)
            blocks.remove()
            return gap
        betas.append(rest)

        def turned(batches: Iterator[pa.RecordBatch], c=c, rest=rest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    v = dict(zip(VECTORS, _read(row, *VECTORS), strict=True))
                    yield sent(row["i"], v["u"], v["q"], sum(x * v[k] for k, x in c.items()) / rest)

        state = now.select("i", *VECTORS).mapInArrow(turned, "i int, u binary, p binary, q binary, s binary")
