"""Scores as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of labels and what they count as.
LABELS = ("information", "misinformation", "disinformation", "ambiguous")
CANON = {
    "information": ("information", "info", "true", "truth"),
    "misinformation": ("misinformation", "misinfo", "error"),
    "disinformation": ("disinformation", "disinfo", "propaganda"),
}


def with_bounds(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds each expression under its name and, as NAME_low and NAME_high, its extremes over all rows: one row, broadcast."""
    df = df.withColumns(columns)
    extremes = df.agg(*[f(c).alias(f"{c}_{side}") for c in columns for f, side in ((F.min, "low"), (F.max, "high"))])
    return df.crossJoin(F.broadcast(extremes))


def scaled(c: str, constant: float = 1.0) -> Column:
    """A column that with_bounds made, to [0, 1]."""
    low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(constant))


def minmax(df: DataFrame, c: Column, out: str, constant: float = 1.0) -> DataFrame:
    """Adds an expression scaled to [0, 1] over all rows."""
    return with_bounds(df, _x=c).withColumn(out, scaled("_x", constant)).drop("_x", "_x_low", "_x_high")


def stability(entropy: Column, coherence: Column, mode: str = "classic") -> Column:
    """classic: C / (1 + H); entropy_weighted: C exp(-H). Other modes count as classic."""
    h = F.greatest(entropy, F.lit(0.0))
    return coherence * F.exp(-h) if mode == "entropy_weighted" else coherence / (1 + h)


def with_stability(df: DataFrame, mode: str = "classic") -> DataFrame:
    """Adds stability of entropy and coherence; normalized: scaled C times 1 - scaled H, a constant stays as it is."""
    if mode != "normalized":
        return df.withColumn("stability", stability(F.col("entropy"), F.col("coherence"), mode))
    part = lambda c: F.when(F.col(f"{c}_high") > F.col(f"{c}_low"), (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low") + 1e-12)).otherwise(F.col(c))
    bounded = with_bounds(df, entropy=F.col("entropy"), coherence=F.col("coherence"))
    return bounded.withColumn("stability", part("coherence") * (1 - part("entropy"))).drop(*[f"{c}_{x}" for c in ("entropy", "coherence") for x in ("low", "high")])


def information_stability(coherence: Column, entropy: Column) -> Column:
    """Half of C + 1 - H, in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * (coherence + 1 - entropy)))


def adaptive_threshold(h: Column, high: float = 0.40, low: float = 0.15, lowest: float = 0.1, highest: float = 4.0, scale: float = 2.8) -> Column:
    """A similarity threshold that falls with entropy."""
    return F.when(h <= lowest, high).when(h >= highest, low).otherwise(low + (high - low) * F.exp(-h / scale))


def condensation_threshold(h: Column) -> Column:
    return adaptive_threshold(h, 0.97, 0.80, 0.01, 5.0, 3.0)


def with_temperature(df: DataFrame) -> DataFrame:
    """Adds temperature: scaled H - C; one half where all are alike."""
    span = F.col("_x_high") - F.col("_x_low")
    value = F.when(span < 1e-9, F.lit(0.5)).otherwise((F.col("_x") - F.col("_x_low")) / (span + 1e-9))
    return with_bounds(df, _x=F.col("entropy") - F.col("coherence")).withColumn("temperature", value).drop("_x", "_x_low", "_x_high")


def canonical_label(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return reduce(lambda out, x: out.when(t.isin(*x[1]), x[0]), CANON.items(), F.when(t.isNull(), "ambiguous")).otherwise("ambiguous")


def polarity(info: Column, mis: Column, dis: Column) -> Column:
    top = F.greatest(info, mis, dis)
    named = lambda c: (top == c) & (c > 0.5)
    return (
        F.when((info + mis + dis < 1e-6) | (top < 0.25), "neutral")
        .when(named(info), "informationally stable")
        .when(named(dis), "highly polarized / disinfo-prone")
        .when(named(mis), "noisy / misinfo-prone")
        .otherwise("neutral")
    )


def dominant_regime(info: Column, mis: Column, dis: Column) -> Column:
    return F.when((dis > mis) & (dis > info), "disinformation").when((mis > info) & (mis > dis), "misinformation").otherwise("information")


def shannon_bits(parts: list[Column]) -> Column:
    return reduce(lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0), parts, F.lit(0.0))


def core_score(tf: Column, df: Column) -> Column:
    return F.log1p(tf) + 0.5 * F.log1p(df)


def with_clipped_z(df: DataFrame, c: Column, out: str) -> DataFrame:
    """Adds the z-score of an expression over all rows, clipped at 4; mean and spread are one row, broadcast."""
    df = df.withColumn("_x", c)
    stats = df.agg(F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_spread"))
    z = F.when(F.col("_spread") > 0, F.least(F.lit(4.0), F.greatest(F.lit(-4.0), (F.col("_x") - F.col("_mean")) / F.col("_spread")))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z).drop("_x", "_mean", "_spread")


def spectral_entropy(v: Column) -> Column:
    """Entropy of a vector's magnitudes over its greatest possible value, in [0, 1]."""
    magnitude = F.transform(v, lambda x: F.abs(x))
    total = F.aggregate(magnitude, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(magnitude, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
    return F.when((F.size(v) > 1) & (total > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), bits / F.log2(F.size(v).cast("double"))))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def edge_kind(given: Column, compound: Column, weight: Column) -> Column:
    return F.coalesce(given, F.when(compound.isNotNull(), "compound").when(weight < 0.15, "semantic").otherwise("cooccur"))


def event_class(c: Column) -> Column:
    """A classification by its first letters; what is unknown or missing counts as information."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.startswith("dis"), "Disinformation").when(t.startswith("mis"), "Misinformation").when(t.startswith("pri"), "Information (Primary source)").when(t.startswith("cor"), "Information (Corrective)").otherwise("Information")


def timeline_class(c: Column) -> Column:
    """The same with four classes; what is unknown or missing is unclassified."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.startswith("dis"), "Disinformation").when(t.startswith("mis"), "Misinformation").when(t.startswith("pri") | t.startswith("cor") | t.startswith("info"), "Information").otherwise("Unclassified")


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def code_score(overlap: Column, path_hits: Column, size: Column) -> Column:
    return overlap + 1.5 * path_hits + 2000.0 / (1000.0 + size)


def search_score(text: Column, needle: str) -> Column:
    """One over one plus the place of the match; null without one."""
    at = F.instr(F.lower(text), needle.lower())
    return F.when(at > 0, 1.0 / at)
