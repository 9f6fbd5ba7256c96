"""Words of code, and tables of roots."""

import pytest

from spanloom.functions import text
from spanloom.operators import terms

CODE = '''"""Field of MoleculeTable."""
# see HTTPServer notes
def load_lsa_field(self, df, tmp, x, ID2):
    \'\'\'Old names_here\'\'\'
    path = "/data/lsa_field.csv"; other = "C:\\\\runs\\\\one.txt"  # ABCd end
    return True, None, ValueError, print(len(args)), 12345, fooBAr, __init__, HTTP_server
'''
CASES = {
    "HTTPServer": ["http", "server"],
    "camelCase snake_case": ["camel", "case", "snake", "case"],
    "loadABCd XYZ": ["load", "xyz"],
    "HTTP_server x _A_ 42 a1 df": ["server", "_a_", "df"],
    "self args kwargs tmp class lambda isinstance": [],
    "True None ValueError": ["true", "none", "value", "error"],
    "": [],
    None: None,
}


@pytest.mark.parametrize("code", CASES)
def test_identifiers(spark, code):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(text.identifiers(df.c)).head()[0] == CASES[code]


def test_code_tokens(spark):
    df = spark.createDataFrame([(CODE,), (None,), ("",)], "c string")
    whole, nothing, empty = (r[0] for r in df.select(text.code_tokens(df.c)).collect())
    notes = ["field", "molecule", "table", "old", "names", "here", "see", "http", "server", "notes", "end"]
    body = ["load", "lsa", "field", "df", "path", "other", "true", "none", "value", "error", "foo", "init", "server"]
    assert whole == notes + body and nothing == empty == []
    # In another language # begins no comment, and the whole text is in its order.
    other = df.select(text.code_tokens(df.c, "c")).head()[0]
    assert other[:6] == ["field", "molecule", "table", "see", "http", "server"]


def test_root_tables(spark):
    freqs = spark.createDataFrame([("walking", 5, 2), ("walked", 9, 3), ("walk", 5, 2), ("tree", 1, 1)], "element string, collection_freq long, span_freq long")
    table, clusters = terms.root_tables(freqs)
    assert sorted((r.element, r.root_id, r.representative, r.size) for r in table.collect()) == [("tree", "R0002", "tree", 1), ("walk", "R0001", "walked", 3), ("walked", "R0001", "walked", 3), ("walking", "R0001", "walked", 3)]
    assert {r.root_id: (r.members, r.total_freq) for r in clusters.collect()} == {"R0001": (["walk", "walked", "walking"], 19), "R0002": (["tree"], 1)}
    assert terms.root_tables(freqs.limit(0))[1].collect() == []
