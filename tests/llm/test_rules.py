"""Line rules with small limits against a plain version; both ways of finding repeated words."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, rules


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def plain(rows, max_docs, depleted, min_words):
    normal = lambda x: " ".join(words_of(x)).lower()
    texts = defaultdict(set)
    for _, host, text in rows:
        for line in (text or "").split("\n"):
            if words_of(line):
                texts[host, normal(line)].add(text)
    out = []
    for i, host, text in rows:
        words = words_of(text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        gone = sum(len(words_of(x)) for x in (text or "").split("\n") if words_of(x) and len(texts[host, normal(x)]) > max_docs)
        failed = len(words) < min_words or 100 * len(repeated) > 50 * len(words)
        out.append((i, len(words), len(repeated), gone, failed, not failed and gone <= depleted * len(words) and len(words) - gone >= min_words))
    return sorted(out, key=str)


@pytest.mark.parametrize(("max_docs", "min_words"), [(1, 50), (2, 20), (6, 50)])
def test_line_rules_against_a_plain_version(spark, max_docs, min_words):
    rows = duckdb.sql("SELECT doc_id, source, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows += [(-1, None, "a b c\na b c\nx"), (-2, None, "A  b c\ny"), (-3, None, "\ta b c \nz"), (-4, "h", None), (-5, "h", ""), (-6, None, "a b c\na b c\nx"), (-6, "h", "a b c")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, source string, text string, lines int, row string")
    found = rules.line_rules(df, max_docs=max_docs, min_words=min_words)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_repeat_words", "n_removed_words", "base_failed", "kept").collect()), key=str)
    said = plain(rows, max_docs, 0.5, min_words)
    assert got == said
    # The limits remove lines and reject documents here.
    assert sum(r[3] > 0 for r in said) > 50
    assert max_docs > 2 or any(not r[4] and not r[5] for r in said)


def test_both_ways_of_finding_repeated_words(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id % 5 = 0").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", common.words_of(F.col("text")))
    one, two = ({r.doc_id: r.n_repeat_words for r in rules.with_repeats(df, few=few).collect()} for few in (0, 1 << 30))
    assert one == two == {i: r for i, _, r, *_ in plain([(i, "h", t) for i, t in rows], 10**9, 1, 0)}
    assert any(one.values())
