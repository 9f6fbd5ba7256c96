"""Sketches: merging parts, containment, distinct counts, and the order of successors on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import sketches


def sketch_rows(spark, texts, k=128):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r.i: r.s for r in sketches.with_sketch(df, "t", "s", k).collect()}


def numbers(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    # Shingles that lie inside the parts: the second begins four words early.
    texts = [numbers(0, 500), numbers(496, 900), numbers(0, 900), ""]
    s = sketch_rows(spark, texts)
    df = spark.createDataFrame([(s[0], s[1], s[2], s[3])], "a array<long>, b array<long>, c array<long>, e array<long>")
    r = df.select(sketches.merge(F.col("a"), F.col("b")).alias("m"), sketches.merge(F.col("a"), F.col("e")).alias("n")).head()
    assert r.m == s[2] and r.n == s[0]


@pytest.mark.parametrize(("a", "b"), [((0, 100), (0, 60)), ((0, 60), (30, 90)), ((0, 4), (0, 4)), ((0, 3), (5, 8)), ((0, 0), (0, 9)), ((0, 3000), (1500, 4500)), ((0, 3000), (0, 6000))])
def test_estimates(spark, a, b):
    s = sketch_rows(spark, [numbers(*a), numbers(*b)])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := numbers(*x).split()) > 4 else {tuple(w)} if w else set() for x in (a, b)]
    df = spark.createDataFrame([(s[0], s[1])], "a array<long>, b array<long>")
    x, y = F.col("a"), F.col("b")
    r = df.select(sketches.resemblance(x, y).alias("j"), sketches.containment(x, y).alias("c"), sketches.distinct_count(x).alias("n")).head()
    both = len(sets[0] & sets[1])
    exact = max(map(len, sets)) < 128
    assert r.j == pytest.approx(both / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0, abs=1e-9 if exact else 0.13)
    assert r.c == pytest.approx(both / len(sets[0]) if sets[0] else 1.0, abs=1e-9 if exact else 0.2)
    assert r.n == pytest.approx(len(sets[0]), rel=1e-9 if exact else 0.3)


def test_successors_on_an_odd_table(spark, monkeypatch):
    rows = [(5, "five five"), (None, "zz"), (3, None), (None, "aa"), (3, "drei"), (9, "neun " * 50), (-7, "x"), (5, "fünf \U0001F600 ü")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, sketch string")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    said = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        said.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    key = lambda r: str(r)
    found = sketches.fingerprints(df).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(said, key=key)
    with_next = sketches.with_next
    monkeypatch.setattr(sketches, "with_next", lambda d: with_next(d, rows_per_range=2))
    dealt = sketches.fingerprints(df).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, dealt), key=key) == sorted(said, key=key)
    assert sketches.fingerprints(df.limit(0)).collect() == []
