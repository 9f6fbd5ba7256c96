"""Line dedup against plain counts; levels, merges, repeated batches and odd tables."""

import hashlib
import os
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, linelevels


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables in many rounds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(common.SPACES).translate(LOWER)


def plain(texts, limit):
    lists = [(t or "").split("\n") for t in texts]
    docs = Counter(k for lines in lists for k in {key(x) for x in lines} if k)
    out = []
    for lines in lists:
        left = [x for x in lines if docs.get(key(x), 0) < limit]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def keys_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(linelevels.line_keys(F.col("text")).alias("keys"))


def shown(frequent):
    return {tuple(r) for r in frequent.collect()}


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, n, k, sha(t)) for r, (n, k, t) in zip(docs, plain([r.text for r in docs], 10))]
    found = [tuple(r) for r in linelevels.op12_line_levels(spark, d).collect()]
    assert sorted(found) == sorted(want) and any(r[2] for r in found)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_batches_and_merges(spark, parts):
    """However the rows are dealt to batches, with merges over several levels, the same lines go."""
    texts = [f"own {k}\n Shared A \nonly {k % 9}\n\nshared a\t\nSome {k % 4}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    found = linelevels.dropped_lines(docs, limit=10, batches=12).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept) for r in found] == plain(texts, 10)


def test_levels(spark, tmp_path):
    runs = linelevels.LineRuns(spark, str(tmp_path / "runs"), limit=3, buckets=3)
    assert shown(runs.frequent()) == set()
    for k in range(7):
        runs.add(keys_of(spark, [f"always\nin {k // 2}\nnew {k}"]), str(k))
    assert sorted((r[0], len(r[2])) for r in runs.runs) == [(0, 1), (1, 2), (2, 4)]
    # What has been settled is not counted on: the newest run does not hold it.
    newest = next(r for r in runs.runs if r[0] == 0)
    assert runs._run(newest[1]).count() == 2
    # A batch is added once; runs are found again under their path.
    again = linelevels.LineRuns(spark, str(tmp_path / "runs"), limit=3, buckets=99)
    assert again.buckets == 3
    again.add(keys_of(spark, ["in 0"] * 5), "0")
    assert len(again.runs) == 3
    again.add(keys_of(spark, ["in 0"]), "other")
    assert len(shown(again.frequent())) == 2 and [(r[0], len(r[2])) for r in again.runs] == [(3, 8)]
    # Merged tables are gone.
    assert len([f for f in os.listdir(tmp_path / "runs") if os.path.isdir(tmp_path / "runs" / f)]) == 1
    again.remove()
    assert not (tmp_path / "runs").exists()


def test_runs_merge_without_a_shuffle(spark, tmp_path):
    runs = linelevels.LineRuns(spark, str(tmp_path / "runs"), limit=3, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, other = (runs._store(keys_of(spark, [f"a\nb {k}"]).select(F.explode("keys").alias("k")).select("k.hash", "k.mark", F.lit(k).cast("long").alias("docs")).repartition(4, "hash", "mark")) for k in (1, 2))
        merged = runs._merged(one, other)
        assert sorted(r.docs for r in merged.collect()) == [1, 2, 3]
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd_and_empty_tables(spark, tmp_path):
    line = "A line\x0bthat İs Shared\x85"
    texts = [None, "", "\n", "  \n\t", line, line.upper(), *[f" {line}\t\n{line}\n\n{k}" for k in range(9)], "x\n" * 9, *["same row"] * 11, "\n".join(f"long {k}" for k in range(40_000)) + f"\n{line}"]
    ids = [None, None, 1, 1, 2, 3, *range(9), 20, *[5] * 11, 99]
    rows = [(i, t, 7, "x", "y") for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_lines int, text_hash string, `gone` string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, n, k, sha(t)) for i, (n, k, t) in zip(ids, plain(texts, 10))]
    found = [tuple(r) for r in linelevels.op12_line_levels(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert linelevels.op12_line_levels(spark, f"{tmp_path}/none").count() == 0
