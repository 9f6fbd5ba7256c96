"""Stored results: read again while nothing changed, made anew otherwise, cleaned; functions of the session."""

import time

import pytest

from spanloom.functions import session
from spanloom.operators import terms
from spanloom.plans.results import Results

ROWS = [(1, "The river rose for three days.\nNobody moved the boats up there."), (2, None), (3, ""), (4, "Tabs\tand  blanks of the river\n\n\nThe river rose again there.")]


def test_results(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    kept = Results(spark, str(tmp_path / "results"))
    assert kept.catalog().collect() == []
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(source)

    def result(factor=1):
        def make():
            made.append(factor)
            return spark.read.parquet(source).selectExpr(f"id * {factor} AS x")

        return kept.table("doubled", [source], {"factor": factor}, make)

    write(5)
    first, new = result()
    assert new and sorted(r.x for r in first.collect()) == [0, 1, 2, 3, 4]
    assert not result()[1] and result(2)[1] and not result(2)[1] and made == [1, 2]
    # A table that was not finished is no result.
    assert kept.catalog().count() == 2 and kept.clean() == 0
    write(7)
    later, new = result()
    assert new and later.count() == 7 and kept.catalog().count() == 3
    assert kept.clean() == 2 and [r.path for r in kept.catalog().collect()] == [later.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")]
    assert kept.clean(before=time.time() + 1) == 1 and kept.catalog().count() == 0
    assert result()[1]
    with pytest.raises(FileNotFoundError):
        kept.table("x", [str(tmp_path / "none")], {}, lambda: spark.range(1))


def test_a_lost_run_leaves_no_result(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    kept = Results(spark, str(tmp_path / "results"))
    with pytest.raises(Exception, match="lost"):
        kept.table("t", [source], {}, lambda: spark.range(3).selectExpr("raise_error('lost') AS x"))
    assert kept.catalog().count() == 0
    assert kept.table("t", [source], {}, lambda: spark.range(3))[1]


def test_functions_in_sql(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for _ in range(2):
        session.register(spark, docs)
    want = {r.element: (r.collection_freq, r.span_freq) for r in terms.frequencies(terms.tokenised(docs)).collect()}
    assert {r.element: (r.collection_freq, r.span_freq) for r in spark.sql("SELECT * FROM corpus_frequencies(1)").collect()} == want
    assert want["river"] == (3, 3) and want["the river"] == (3, 3)
    assert {r.element for r in spark.sql("SELECT * FROM corpus_frequencies(2)").collect()} == {e for e, (_, n) in want.items() if n >= 2}
    row = spark.sql("SELECT corpus_squeeze(' a\t b\n\n\nc ') AS s, corpus_squeeze(NULL) AS z, corpus_entropy(array(1D, 1D)) AS h, corpus_phrases(array('a')) AS p").head()
    assert (row.s, row.z, round(row.h, 9), row.p) == ("a b\nc", "", 0.693147181, [])
    plan = spark.sql("SELECT * FROM corpus_frequencies(1)")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_another_tokenizer(spark):
    docs = spark.createDataFrame([(1, "Größe und Größe von Häusern\nHäuser haben eine Größe hier")], "doc_id long, text string")
    from spanloom.functions import text

    found = {r.element for r in terms.statistics(docs, tokens=text.word_characters).collect()}
    assert "größe" in found and "größe" not in {r.element for r in terms.statistics(docs).collect()}
