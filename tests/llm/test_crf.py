"""The document score against enumeration, long texts in parts, and odd labels."""

import resource
from itertools import product

import numpy as np
import pytest

from spanloom.llm import crf

TABLE = crf.class_table()
WORDS = ["the", "quick", "of", "### !", "12 34", "Fox", ""]


def model(seed=1):
    rng = np.random.default_rng(seed)
    return crf.Model(rng.normal(size=3 * crf.N_BASE) * 0.3, rng.normal(size=(2, 2)))


def plain_score(text, m):
    """All labellings of the lines, one by one; each line sees its own features and its neighbours'."""
    own, size, _ = crf.line_features([text], TABLE)
    zero = np.zeros(crf.N_BASE)
    n = len(own)
    e = [float(np.concatenate((own[t], own[t - 1] if t else zero, own[t + 1] if t + 1 < n else zero)) @ m.weights) for t in range(n)]
    total, ones = 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(e[t] * y[t] for t in range(n)) + sum(m.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, ones = total + w, ones + w * np.array(y)
    weight = size if size.sum() else np.ones(n)
    return float((ones / total) @ weight / weight.sum())


@pytest.mark.parametrize("long", [4_096, 2])
def test_document_score_against_enumeration(long):
    rng, m = np.random.default_rng(4), model()
    texts = ["", "\n\n", "one line", *["\n".join(rng.choice(WORDS, k)) for k in (2, 5, 8, 10)]]
    said = [plain_score(t, m) for t in texts]
    assert crf.document_scores(texts, TABLE, m, long) == pytest.approx(said)
    assert [float(crf.document_scores([t], TABLE, m, long)[0]) for t in texts] == pytest.approx(said)


def test_a_long_text_of_short_lines():
    text = "\n".join(np.random.default_rng(2).choice(WORDS[:-1], 400_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (score,) = crf.document_scores([text], TABLE, model())
    assert 0 <= score <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_training_on_odd_labels(spark):
    docs = spark.createDataFrame([(1, "fine text here", "x"), (1, "a second text of that id", "x"), (2, None, "y"), (3, "### !!! ###\n" * 2_000, "y"), (None, "no id", "z")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    m = crf.train(docs, labels, max_lines=8)
    rows = crf.scored(docs.drop("quality"), m).collect()
    assert len(rows) == 5
    assert all(0 <= r._crf_score <= 1 for r in rows)
    empty = crf.train(docs.limit(0), labels)
    assert not empty.weights.any()
    assert [r._crf_score for r in crf.scored(docs.drop("quality"), empty).collect()] == pytest.approx([0.5] * 5)
    assert spark.createDataFrame([(None,), (5,)], "doc_id long").select(crf.held_out(__import__("pyspark").sql.functions.col("doc_id"))).collect()[0][0] is False
