"""One-row reports over element tables, and what they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of the four rules.
RULES = (("entropy_high", "entropy_high_fraction", 0.25), ("coherence_low", "coherence_low_fraction", 0.20), ("stability_low", "stability_low_fraction", 0.20), ("documents_uneven", "doc_stability_spread", 0.25))


def share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def field_stats(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Means, medians, tails and shares of entropy, coherence and stability, and the spread of the documents' stability: one row.

    elements: entropy, coherence, stability; documents: mean_stability.
    """
    bar = F.broadcast(elements.agg((F.avg("entropy") + F.stddev_samp("entropy")).alias("_bar")))
    part = lambda c, p=0.5: F.percentile(c, F.lit(p))
    spread = documents.agg(F.stddev_samp("mean_stability").alias("doc_stability_spread"))
    stats = elements.crossJoin(bar).agg(
        F.avg("entropy").alias("entropy_mean"), part("entropy").alias("entropy_median"), part("entropy", 0.9).alias("entropy_p90"), F.max("entropy").alias("entropy_max"), share(F.col("entropy") > F.col("_bar")).alias("entropy_high_fraction"),
        F.avg("coherence").alias("coherence_mean"), part("coherence").alias("coherence_median"), share(F.col("coherence") < 0.6).alias("coherence_low_fraction"), F.min("coherence").alias("coherence_min"),
        F.avg("stability").alias("stability_mean"), part("stability").alias("stability_median"), share(F.col("stability") < 0.25).alias("stability_low_fraction"), part("stability", 0.1).alias("stability_p10"),
    )
    return stats.crossJoin(spread)


def suggestions(field: DataFrame) -> DataFrame:
    """severity (how many of four limits a field passes), and the rules' names."""
    found = F.array_compact(F.array(*[F.when(F.col(c) > bar, name) for name, c, bar in RULES]))
    return field.select(F.size(found).alias("severity"), F.array_join(found, ",").alias("rules"))


def lines(facts: DataFrame) -> DataFrame:
    """A line "name: value" for each column of a one-row table."""
    return facts.select(F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in facts.columns])).alias("line"))
