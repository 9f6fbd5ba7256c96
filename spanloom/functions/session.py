"""The engine's text functions for SQL texts: functions with SQL bodies, registered in a session.

Their bodies are expressions, so Catalyst inlines them into the query, with code generation and pruning as for
built-in functions; no Python runs. Names begin with `corpus_`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.text import SPACE, STRUCTURAL, WORD


def _quoted(pattern: str) -> str:
    return f"r'{pattern}'"


_STRIP = _quoted(f"^{SPACE}+|{SPACE}+$")
_LETTERS = "length(regexp_replace(s, r'[^\\p{L}]', ''))"
#: Name with arguments, type, body. A body may use the functions before it.
FUNCTIONS = (
    ("corpus_squeeze(c STRING)", "STRING", f"regexp_replace(regexp_replace(regexp_replace(coalesce(c, ''), '[ \\t]+', ' '), '\\n{{2,}}', '\\n'), {_STRIP}, '')"),
    ("corpus_spans(c STRING)", "ARRAY<STRING>", f"filter(transform(split(corpus_squeeze(c), '\\n'), s -> regexp_replace(s, {_STRIP}, '')), s -> CASE WHEN length(s) < 20 THEN {_LETTERS} >= 10 ELSE {_LETTERS} / length(s) >= 0.3 END)"),
    ("corpus_tokens(c STRING)", "ARRAY<STRING>", f"filter(transform(regexp_extract_all(c, '{WORD}', 0), t -> regexp_replace(lower(t), '[^a-z]+', '')), t -> length(t) > 2 AND NOT t RLIKE '^({'|'.join(STRUCTURAL)})' AND t RLIKE '[aeiou]')"),
    ("corpus_phrases(t ARRAY<STRING>)", "ARRAY<STRING>", "CASE WHEN size(t) > 1 THEN zip_with(slice(t, 1, size(t) - 1), slice(t, 2, size(t) - 1), (a, b) -> a || ' ' || b) ELSE CAST(array() AS ARRAY<STRING>) END"),
    ("corpus_entropy(w ARRAY<DOUBLE>)", "DOUBLE", "aggregate(w, CAST(0 AS DOUBLE), (s, x) -> s - CASE WHEN x > 0 THEN x / aggregate(w, CAST(0 AS DOUBLE), (a, b) -> a + b) * ln(x / aggregate(w, CAST(0 AS DOUBLE), (a, b) -> a + b)) ELSE 0 END)"),
)
#: Table functions over the view `corpus_documents` (doc_id, text); Spark allows no function with an SQL body right inside of an explode.
#: They take numbers and no texts: a lateral join with a text would be planned as a join on whole texts.
TABLES = (
    (
        "corpus_frequencies(least INT)",
        "TABLE(element STRING, collection_freq BIGINT, span_freq BIGINT)",
        """WITH s AS (SELECT doc_id, corpus_spans(text) AS spans FROM corpus_documents),
t AS (SELECT doc_id, position, corpus_tokens(span) AS tokens FROM s LATERAL VIEW posexplode(spans) x AS position, span),
e AS (SELECT doc_id, position, concat(tokens, corpus_phrases(tokens)) AS elements FROM t),
o AS (SELECT inline(concat(transform(elements, x -> struct(x AS element, 1 AS n, 0 AS once)), transform(array_distinct(elements), x -> struct(x AS element, 0 AS n, 1 AS once)))) FROM e),
f AS (SELECT element, sum(n) AS collection_freq, sum(once) AS span_freq FROM o GROUP BY element)
SELECT * FROM f WHERE span_freq >= corpus_frequencies.least""",
    ),
)


def register(spark: SparkSession, docs: DataFrame) -> None:
    """Makes the functions known in the session, with `docs` as the view; once more replaces them."""
    docs.createOrReplaceTempView("corpus_documents")
    for name, kind, body in (*FUNCTIONS, *TABLES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
