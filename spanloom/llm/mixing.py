"""Mixing sources to target weights by hash-random keys, a range sort per source and distributed prefix sums.

Every document gets a pseudo-random key (the MD5 of a seed and its id). Within a source the keys are cut into
equal ranges, one for about `rows_per_range` rows, so that a source with a third of all rows is spread over many
tasks. A window sums sizes inside a range; the sums of the ranges before it, a table with a row per range, give
the rest of the prefix. A source's budget is its target in whole words: as many whole epochs as fit, then the
documents in key order up to the remainder, the last of them in part.

Defined cases: null texts have size 0; a null source is a source of its own and comes last; null ids are keyed
by their text, so that many of them spread like others; repeated rows are separate documents; an empty table gives an empty result; if all sizes
are 0, so is every target. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import common


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets of (source, skey, source_size, n): the level at which weight times level, capped at max_epochs times the size, sums to all sizes.

    The windows here run over a row per source, never over documents.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    capped = weighted.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = capped.withColumn("level", left / weight_left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.struct(-F.col("ratio"), -F.col("weight"), "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.least(F.coalesce(level, F.lit(0.0)) * F.col("weight"), F.col("cap"))).drop("level", "ratio", "cap")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 11, rows_per_range: int = 2_000, carry: Sequence[str] = ()) -> DataFrame:
    """The columns to carry, doc_id, source, size, source_size, target, epochs (whole ones), taken: how many words of each document the mix takes."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    sized = docs.select(*carry, "doc_id", "source", F.size(common.words_of(F.col("text"))).cast("long").alias("size"), key.alias("key"))
    keyed = sized.withColumns({"skey": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))})
    keyed, _ = common.written(keyed, "sizes")
    sizes = keyed.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, max_epochs).select("skey", "source_size", "target", F.ceil(F.col("n") / rows_per_range).alias("n_ranges"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    # The range of a row depends on how many its source has: a coarse cell first, so that cells, not sources, meet in the join.
    cells = keyed.withColumn("cell", (place / 2**24).cast("int"))
    spread = targets.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(255))))
    ranged = cells.join(spread, ["skey", "cell"]).withColumn("range", F.floor(place * F.col("n_ranges") / 2**32))
    sums = ranged.groupBy("skey", "range").agg(F.sum("size").alias("in_range"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(upto)).join(offsets.drop("in_range"), ["skey", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return placed.withColumn("epochs", epochs.cast("long")).select(*carry, "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL for the rows of mix() over a relation {docs}.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM {docs}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap
  FROM sources),
leveled AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM weighted WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level AS water FROM leveled WHERE level <= ratio ORDER BY ratio, weight, level DESC LIMIT 1),
targets AS (SELECT source, source_size, least(coalesce((SELECT water FROM chosen), 0.0) * weight, cap) AS target FROM leveled),
budgets AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.budget, b.epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
mixed AS (
  SELECT doc_id, source, size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
    CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken
  FROM placed)
"""
OP8_SQL = "WITH " + MIX_SQL.replace("{docs}", "documents") + " SELECT doc_id, size, source_size, target, taken FROM mixed"
