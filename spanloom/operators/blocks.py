"""Graphs as tables of blocks, for searches and iterations that go over all edges many times.

Nodes are numbered in their order and dealt to blocks of as many numbers. A piece holds the entries of the adjacency
matrix between a block of rows and a block of columns as arrays, and pieces are a table bucketed by the block of rows,
one block to a bucket, so they are shuffled once. A round is a cogroup: what moves is a row of arrays for each block of
nodes and each block of rows that has entries in it, not a row for each edge. A kernel works on one block of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.tables import cut, new_path, ranked, remove, remove_path

#: The kinds of a kernel's columns.
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

#: A piece in a kernel: the block of its columns, local rows (ascending) and columns, weights (None: all 1).
Piece = tuple[int, np.ndarray, np.ndarray, "np.ndarray | None"]


def _dealt(size: int, weighted: bool) -> Callable:
    """Both directions of the edges, as arrays for each block of rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def rows() -> pa.RecordBatch:
            a, b, w = (np.concatenate([h[k] for h in held]) for k in range(3))
            a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
            order = np.argsort(a // size, kind="stable")
            a, b, w = a[order], b[order], w[order]
            found, first = np.unique(a // size, return_index=True)
            ends = [*first[1:], len(a)]
            part = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary())
            last = part(w) if weighted else pa.array([b""] * len(found), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), part(a.astype(np.int32)), part(b.astype(np.int32)), last], names=["i", "a", "b", "w"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            count += batch.num_rows
            if count >= 1 << 20:
                yield rows()
                held, count = [], 0
        if count:
            yield rows()

    return deal


def _packed(size: int, weighted: bool) -> Callable:
    """The pieces of a block of rows; equal entries become one, their weights summed."""

    def pack(table: pa.Table) -> pa.Table:
        i, key = table.column("i")[0].as_py(), table.column("key")[0].as_py()
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
        a, b = read("a", np.int32).astype(np.int64), read("b", np.int32).astype(np.int64)
        j = b // size
        code = (j * size + (a - i * size)) * size + (b - j * size)
        if weighted:
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            w = np.add.reduceat(read("w", np.float64)[order], first)
            code = code[first]
        else:
            code, w = np.unique(code), None
        j, rows, cols = code // size // size, (code // size % size).astype(np.int32), (code % size).astype(np.int32)
        found, first = np.unique(j, return_index=True)
        ends = [*first[1:], len(j)]
        cut_ = lambda x: [x[s:e].tobytes() for s, e in zip(first, ends, strict=True)]
        ones = w is None or bool((w == 1.0).all())
        return pa.table({"key": pa.array([key] * len(found), pa.int64()), "i": pa.array([i] * len(found), pa.int32()), "j": pa.array(found, pa.int32()), "rows": pa.array(cut_(rows), pa.binary()), "cols": pa.array(cut_(cols), pa.binary()), "w": pa.array([b""] * len(found) if ones else cut_(w), pa.binary())})

    return pack


class Blocks:
    """The blocks of a graph. edges: source, target, and weight if `weight` names one.

    how: "set" takes an edge once, "sum" adds up the weights (1 without any) of equal entries; a loop has an entry each
    way. `entries` is about what a block of rows holds; a graph of at most `whole` entries is one block.
    """

    def __init__(self, edges: DataFrame, how: str = "set", weight: str | None = None, entries: int = 1 << 21, whole: int = 0):
        self.spark = spark = edges.sparkSession
        nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        #: node, number (from 0, in the order of nodes)
        self.nodes = cut(ranked(nodes, "node").select("node", (F.col("place") - 1).cast("long").alias("number")))
        self.n, m = self.nodes.count(), edges.count()
        self.empty = not self.n
        if self.empty:
            return
        cores = max(1, spark.sparkContext.defaultParallelism)
        # A small graph is not spread over all cores.
        self.size = self.n if 2 * m <= whole else -(-self.n // max(1, min(self.n, max(min(cores, 2 * m >> 17), -(-2 * m // entries)))))
        self.count = -(-self.n // self.size)
        weighted = how == "sum"
        at = lambda side, name: self.nodes.select(F.col("node").alias(side), F.col("number").alias(name))
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        known = edges.select("source", "target", w.alias("w")).join(at("source", "a"), "source").join(at("target", "b"), "target").select("a", "b", "w")
        dealt = known.mapInArrow(_dealt(self.size, weighted), "i int, a binary, b binary, w binary")
        # For each block a key that the shuffle's own hash deals to a partition of its own.
        keys = spark.range(64 * self.count).groupBy(F.pmod(F.hash("id"), F.lit(self.count)).alias("i")).agg(F.min("id").alias("key"))
        self.keys = {r["i"]: r["key"] for r in keys.collect()}
        named = spark.createDataFrame([(i, self.keys.get(i, i)) for i in range(self.count)], "i int, key long")
        pieces = dealt.join(F.broadcast(named), "i").repartition(self.count, "key").groupBy("key").applyInArrow(_packed(self.size, weighted), "key long, i int, j int, rows binary, cols binary, w binary")
        self.name, self.path = f"spanloom_blocks_{uuid.uuid4().hex}", new_path(spark)
        pieces.write.bucketBy(self.count, "key").option("path", self.path).saveAsTable(self.name)
        own = named.select(F.col("i").alias("j"), "key", "i")
        #: j, key, i: the blocks of rows that have entries in the columns of block j, itself always among them.
        self.needs = cut(spark.table(self.name).select("j", "key", "i").union(own).distinct().coalesce(1))

    def __len__(self) -> int:
        return self.count

    def state(self, rows: DataFrame, **columns: str) -> DataFrame:
        """i and an array for each column, from rows of number and the columns; columns name NumPy kinds. Numbers without a row are 0."""
        size, n = self.size, self.n

        def pack(table: pa.Table) -> pa.Table:
            number = table.column("number").to_numpy()
            i = int(number[0]) // size
            out = {"i": pa.array([i], pa.int32())}
            for c, kind in columns.items():
                x = np.zeros(min(size, n - i * size), kind)
                x[number - i * size] = table.column(c).to_numpy()
                out[c] = pa.array([x.tobytes()], pa.binary())
            return pa.table(out)

        block = rows.select(F.floor(F.col("number") / size).cast("int").alias("i"), "number", *columns)
        return block.groupBy("i").applyInArrow(pack, ", ".join(["i int", *[f"{c} binary" for c in columns]]))

    def rows(self, state: DataFrame, **columns: str) -> DataFrame:
        """number and the columns, a row for each number, from a state's arrays."""
        size = self.size
        kinds = {"f8": ("double", pa.float64()), "i8": ("long", pa.int64())}

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    arrays = [np.frombuffer(r[c], kind) for c, kind in columns.items()]
                    for k in range(0, len(arrays[0]), 1 << 16):
                        some = [x[k : k + (1 << 16)] for x in arrays]
                        number = np.arange(len(some[0]), dtype=np.int64) + (r["i"] * size + k)
                        yield pa.RecordBatch.from_arrays([pa.array(number), *[pa.array(x, kinds[kind][1]) for x, kind in zip(some, columns.values(), strict=True)]], names=["number", *columns])

        return state.select("i", *columns).mapInArrow(spread, ", ".join(["number long", *[f"{c} {kinds[kind][0]}" for c, kind in columns.items()]]))

    def step(self, state: DataFrame, kernel: Callable, schema: str, send: list[str], keep: list[str] = ()) -> DataFrame:
        """What the kernel makes of each block of rows.

        kernel(i, number of rows, pieces, held) gives columns as lists; held has the sent columns of each needed block
        (as bytes, by block), and of block i the kept ones too.
        """
        size, n = self.size, self.n
        sent = state.withColumnRenamed("i", "j").join(F.broadcast(self.needs), "j")
        sent = sent.select("key", "j", *send, *[F.when(F.col("i") == F.col("j"), F.col(c)).alias(c) for c in keep])
        kinds = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")])

        def meet(own: pa.Table, given: pa.Table) -> pa.Table:
            held = {r["j"]: r for r in given.to_pylist()}
            if not own.num_rows or not held:
                return kinds.empty_table()
            i = own.column("i")[0].as_py()
            array = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
            pieces = [
                (own.column("j")[k].as_py(), array(own.column("rows")[k], np.int32), array(own.column("cols")[k], np.int32), array(own.column("w")[k], np.float64) if len(own.column("w")[k].as_buffer()) else None)
                for k in range(own.num_rows)
                if own.column("j")[k].as_py() in held
            ]
            made = kernel(i, min(size, n - i * size), pieces, held)
            return pa.table([pa.array(made[c.name], c.type) for c in kinds], schema=kinds)

        return self.spark.table(self.name).groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(meet, schema)

    def remove(self) -> None:
        """Deletes the pieces and what goes with them, when no result reads them any more."""
        remove(self.nodes)
        if not self.empty:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            remove_path(self.spark, self.path)
            remove(self.needs)


def summed(rows: int, pieces: list[Piece], held: dict, column: str) -> np.ndarray:
    """The sums over the entries of each row of weight times the column's value there."""
    total = np.zeros(rows)
    for j, r, c, w in pieces:
        x = np.frombuffer(held[j][column], np.float64)[c]
        total += np.bincount(r, weights=x if w is None else x * w, minlength=rows)
    return total
