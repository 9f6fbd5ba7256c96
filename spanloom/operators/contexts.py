"""What stands around elements and compounds: example spans, supporting spans, keywords, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def examples(tokens: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """element, place, doc_id, position: the first k spans that have each target. tokens: doc_id, position, elements; targets: element (a bounded table)."""
    found = tokens.select("doc_id", "position", F.explode(F.array_distinct("elements")).alias("element")).join(F.broadcast(targets), "element")
    # Of each task's spans k at most go on: the aggregate keeps the least k.
    place = F.row_number().over(Window.partitionBy("element").orderBy("doc_id", "position"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def token_regimes(elements: DataFrame, regimes: DataFrame, names: list[str]) -> DataFrame:
    """element and the mean of each regime over its tokens, 0 for tokens without one. regimes: element (a token) and the names."""
    parts = elements.select("element", F.explode(F.split("element", " ")).alias("token"))
    known = parts.join(regimes.select(F.col("element").alias("token"), *names), "token", "left")
    return known.groupBy("element").agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names])


def supporting_spans(members: DataFrame, spans: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """For each compound its spans' number and the k with the largest overlap; and for each (compound, word) its count over all its spans.

    members: compound, element; spans: span_id, text, elements. A span supports a compound that has one of its elements.
    """
    hits = spans.select("span_id", F.explode(F.array_distinct("elements")).alias("element")).join(members, "element").groupBy("compound", "span_id").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("overlap"), F.desc("text"), "span_id"))
    whole = hits.join(spans.select("span_id", "text"), "span_id")
    best = whole.withColumn("place", place).filter(F.col("place") <= k).select("compound", "place", "overlap", "span_id")
    words = whole.select("compound", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0)).alias("word")).groupBy("compound", "word").agg(F.count("*").alias("n"))
    return best, words


def top_words(words: DataFrame, k: int = 15) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("n"), "word"))
    return words.withColumn("place", place).filter(F.col("place") <= k)
