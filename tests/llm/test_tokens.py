"""Token counts of sections against a plain loop over tokens, for all rules and kinds of sections."""

import re

import duckdb
import pytest

from spanloom.llm import tokens

ODD = [(None, "no id é ü \U0001F600 ▁ x"), (-1, None), (-2, ""), (-3, " \t\n "), (-4, "\U0001F600\n\U0001F601é\n\n漢字漢字\nÿ"), (-5, "a.b!c?d\ne..."), (-6, "one word"), (-6, "one word"), (-7, 'He said "no." Then: "yes!" (a.b) [c?] end.\n\n\n\nx')]


def plain(text, sections, rule, encoding, lengths):
    """Every token one by one: its characters, the section of each, and the rule."""
    text = text or ""
    starts = [m.start() for m in re.finditer(tokens.SECTIONS[sections], text) if m.end() > m.start()] or ([0] if text else [])
    if starts:
        starts[0] = 0
    owner = []
    for k, c in enumerate(text):
        owner += [(k, sum(s <= k for s in starts) - 1)] * len(c.encode())
    counts, crossing, at = [0] * len(starts), 0, 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        own = owner[at : at + lengths[i]]
        at += lengths[i]
        held = dict(own)  # character: section
        found = list(held.values())
        crossing += found[0] != found[-1]
        best = found[0] if rule == "start" else found[-1] if rule == "end" else max(sorted(set(found)), key=found.count)
        counts[best] += 1
    assert at == len(text.encode())
    return len(ids), len(starts), crossing, counts


@pytest.mark.parametrize("sections", ["lines", "paragraphs", "sentences"])
@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_attribution_against_a_loop(spark, sections, rule):
    encoding, lengths = tokens.encoder(tokens.VOCABULARY)
    rows = ODD + duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) < 3000").fetchall()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens int, section_tokens string")
    found = sorted(tuple(r) for r in tokens.attribute(df.fillna(-99, "doc_id"), sections=sections, rule=rule).collect())
    said = sorted((-99 if i is None else i, *plain(t, sections, rule, encoding, lengths)) for i, t in rows)
    assert found == [(i, n, s, c, list(counts)) for i, n, s, c, counts in said]
    assert sum(r[3] for r in said) > 0 or sections == "paragraphs"  # tokens cross there


def test_no_such_rule(spark):
    with pytest.raises(Exception, match="no such rule"):
        tokens.attribute(spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string"), rule="first").collect()
