"""Runs against a plain search of every period, on random words, planted runs and odd tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, repeats


def plain_runs(words, least=24, times=3):
    """For every period the maximal stretches in which words that far apart are equal; of equal stretches the smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fast_runs(lists, least=24, times=3):
    doc, start, length, period = repeats.batch_runs(pa.array(lists, pa.list_(pa.string())), least, times)
    out = [[] for _ in lists]
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append(tuple(r))
    return out


def texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))]
            words += unit * rng.randint(1, 12) + unit[: rng.randint(0, len(unit))]
            words += [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        yield words


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (5, 3)])
def test_runs_of_random_words(seed, least, times):
    lists = list(texts(seed))
    assert fast_runs(lists, least, times) == [plain_runs(w, least, times) for w in lists]


def test_special_words():
    a, fib = ["a"] * 2000, ["b", "a"]
    x, y = ["a"], ["a", "b"]
    while len(y) < 1000:
        x, y = y, y + x
    lists = [[], ["a"], a, a[:23], a[:24], fib * 12, fib * 300 + ["a"], y, (["a"] * 30 + ["c"]) * 5, [], ["q"] * 24 + ["r"] * 24]
    assert fast_runs(lists, 2, 2) == [plain_runs(w, 2, 2) for w in lists]
    assert fast_runs(lists) == [plain_runs(w) for w in lists]


def test_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        words = rng.integers(0, 3, n)
        words[n // 2 :] = words[: n - n // 2]
        tree = repeats.Suffixes(words)
        order = sorted(range(n), key=lambda i: words[i:].tolist())
        assert tree.order.tolist() == order
        lcp = [0] + [next((k for k in range(n) if max(a, b) + k >= n or words[a + k] != words[b + k]), n) for a, b in zip(order[1:], order)]
        assert tree.common.tolist() == lcp


def plain_row(doc_id, text):
    words = [w for w in (text or "").translate(dict.fromkeys(map(ord, common.SPACES), " ")).split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def key(r):
    return str(r)


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    found = {r.doc_id: tuple(r) for r in repeats.op11_runs(spark, d).collect()}
    assert len(found) >= len(docs) and sum(r[1] for r in found.values()) > 5
    for doc_id, text in docs:
        assert found[doc_id] == plain_row(doc_id, text)


def test_odd_and_empty_tables(spark, tmp_path):
    unit = "zwei\x0bdrei\tvier fünf\x85 "
    rows = [(None, unit * 20, "x"), (1, None, "x"), (2, "", None), (2, "", None), (3, " \n\t ", "x"), (4, unit * 9 + "end", "x"), (4, unit * 9 + "end", "x"), (30, "a " * 23, ""), (31, "a " * 24, ""), (10**12, "b c d " * 4000, "")] + [(k, unit * 4 + f"{k} " * 30, "y") for k in range(100, 140)]
    spark.createDataFrame(rows, "doc_id long, text string, words string").withColumn("runs", F.lit(1)).withColumn("_doc_id", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in repeats.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=key) == sorted((plain_row(i, t) for i, t, _ in rows), key=key)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert repeats.op11_runs(spark, f"{tmp_path}/none").count() == 0


def test_long_text(spark):
    """Over a megabyte: a run of 100,000 words between others that never repeat."""
    words = [f"w{k}" for k in range(100_000)] + [f"p{k % 700}" for k in range(100_000)] + [f"v{k}" for k in range(50_000)]
    (row,) = repeats.periodic_runs(spark.createDataFrame([(1, words)], "doc_id long, words array<string>")).collect()
    assert [tuple(r) for r in row.runs] == [(100_000, 100_000, 700)] and len(row.collapsed.split(" ")) == 150_700
