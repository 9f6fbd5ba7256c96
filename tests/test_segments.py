"""Spans, tokens and frequent elements by arrays of bytes against the expressions for each row, on odd texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import segments, terms

PIECES = ["a", "be", "Word", "STOP", "figure", "secret", "Citation", "subsection", "rhythm", "well-known", "x-ray-s", "--", "-", " ", "  ", "\t", "\n", "\n\n", "\r", "\v", "\x85", "\xa0", "é", "Größe", "слово", "語", "𝒜bc", "½", "12", "_", ".", "ſec", "K", "\x1c", " ", "　", "ordinary words here", "other plain line of words"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [None, "", "\n", " \n ", "ten letters exactly", "abcdefghij", "abcdefghi", "\nan informative line", "an informative line\xa0", "a\xa0\x85\nfirst-\nsecond line of text", *made]


def test_spans_and_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    plain = terms.spans(docs).select("doc_id", "position", F.array_join(text.tokens(F.col("span")), " ").alias("t")).collect()
    found = terms.segmented(docs).collect()
    assert sorted((r.doc_id, r.position, r.tokens.strip()) for r in found) == sorted((r.doc_id, r.position, r.t) for r in plain)


def test_the_text_of_spans(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    found = terms.segmented(docs, whole=True).select("doc_id", "position", "span").collect()
    assert sorted(found) == sorted(terms.spans(docs).select("doc_id", "position", "span").collect())


@pytest.mark.parametrize("column", [["one two ", "", "one \ntwo one \n", "\n\none two "], [["one", "two"], [], ["one", None, "two", "one", None], [None, None, "one", "two"]]])
def test_elements(column):
    names, codes, row = segments.Elements(pa.array(column)).coded()
    found = sorted((r, names[c].as_py()) for c, r in zip(codes.tolist(), row.tolist(), strict=True))
    assert found == [(0, "one"), (0, "one two"), (0, "two"), (2, "one"), (2, "one"), (2, "two"), (2, "two one"), (3, "one"), (3, "one two"), (3, "two")]


def test_a_phrase_has_the_bucket_of_its_string():
    elements = segments.Elements(pa.array(["some words of a line "]))
    h = segments.hashes(pa.array(["some words", "words of", "of a", "a line"]))[0]
    assert elements.pair.tolist() == segments.bucket(h).tolist()


@pytest.mark.parametrize("most", [1, 20, 5000])
def test_the_most_frequent(spark, most):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts() * 3)], "doc_id long, text string").repartition(7)
    plain = terms.vocabulary(terms.frequencies(terms.tokenised(docs)), most)
    counted = terms.frequent(terms.segmented(docs), most)
    assert sorted(terms.vocabulary(counted, most).collect()) == sorted(plain.collect())
    # What cannot be wanted is not summed up.
    assert most > 20 or counted.count() < terms.frequencies(terms.tokenised(docs)).count() / 2
