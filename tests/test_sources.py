from pyspark.sql import functions as F

from spanloom.sources import files


def test_corpus_by_kind(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.html").write_text("<p>one</p>  two")
    (tmp_path / "y.py").write_text("x = 1  # a note\n")
    (tmp_path / "z.txt").write_text("plain\n\n\ntext")
    found = {r.kind: r.text for r in files.corpus(spark, str(tmp_path)).collect()}
    assert found == {"html": "one two", "python": "a note", "text": "plain\ntext"}


def test_table_fills_missing_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nbad,y\n")
    rows = files.table(spark, str(tmp_path / "t.csv"), "a int, c double").collect()
    assert [(r.a, r.c) for r in rows] == [(1, None), (None, None)]


def test_notes(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: First\n---\nSee [[second]] and [[third|3]].")
    r = files.notes(spark, str(tmp_path)).head()
    assert (r.title, r.links) == ("First", ["second", "third"])


def test_vectors(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ("no",)], "embedding string")
    assert [r.embedding for r in files.vectors(df).collect()] == [[1.0, 2.5], None]


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "source string, target string, weight int")
    files.write_edges(edges, str(tmp_path / "e"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "e")).filter(F.col("weight") == 2).head().target == "c"
