"""Document fingerprints in DataFrame operations only: bottom-k sketches of word shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (five words; a shorter
text is one shingle, one without words none). Sketches of parts merge into the sketch of the whole. They estimate
resemblance, containment and the number of distinct shingles; all three are exact where both have fewer than k.

The edited text of a document needs its successor in descending id order. Ids are cut into ranges at quantiles;
a window orders each range, and the first document of a range is also dealt to the range before it, where it
follows the last. So each text is shuffled once, and no task holds more than a range.

Defined cases: null texts count as empty; two empty sketches are alike (1); null ids come last; of repeated ids
the lesser text comes first; a single document is its own successor; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import common


def with_sketch(df: DataFrame, text: str, out: str, k: int = 128, width: int = 5) -> DataFrame:
    """Adds the bottom-k sketch of a text column."""
    words, n = f"_w_{out}", F.size(f"_w_{out}")
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(words, common.words_of(F.col(text)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(F.coalesce(common.windows_of(words, width), short))), 1, k)).drop(words)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of two parts together (of shingles that lie inside either)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    kth = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Share of the k smallest hashes of the union that both have."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """A sketch as 16 lowercase hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _range_of(value: Column, edges: list, low: int = 0) -> Column:
    """How many edges are at most the value: a binary search as nested conditions."""
    if not edges:
        return F.lit(low)
    mid = len(edges) // 2
    return F.when(value < edges[mid], _range_of(value, edges[:mid], low)).otherwise(_range_of(value, edges[mid + 1 :], low + mid + 1))


def with_next(docs: DataFrame, rows_per_range: int = 2_000, max_ranges: int = 1_024) -> tuple[DataFrame, object]:
    """doc_id, text, own (false for rows that are only here to be looked at), and the window to look along.

    Quantile edges, at most max_ranges of them, and a row for each range are all that the driver gets to see.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(max_ranges, base.count() // rows_per_range + 1)
    edges = sorted(set(base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).head()[0] or [])) if n > 1 else []
    base = base.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(F.col("doc_id"), edges)))
    # Rows: at most one for each range.
    heads = sorted(base.groupBy("range").agg(F.max("doc_id").alias("head")).collect(), reverse=True)
    to = {r["range"]: heads[i - 1]["range"] for i, r in enumerate(heads)}
    head_of = {r["range"]: r["head"] for r in heads}
    table = F.broadcast(base.sparkSession.createDataFrame([(r, head_of[r], to[r]) for r in to] or [], "at int, head long, before int"))
    met = base.join(table, (F.col("range") == F.col("at")) & F.col("doc_id").cast("long").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("at").isNull(), F.array(F.struct(F.col("range").alias("place"), F.lit(True).alias("own")))).otherwise(
        F.array(F.struct(F.col("range").alias("place"), F.lit(True).alias("own")), F.struct(F.col("before").alias("place"), F.lit(False).alias("own")))
    )
    dealt = met.select("doc_id", "text", F.explode(places).alias("x")).select("doc_id", "text", "x.place", "x.own")
    along = Window.partitionBy("place").orderBy(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return dealt, along


def fingerprints(docs: DataFrame, k: int = 128, width: int = 5) -> DataFrame:
    """A row per document: fingerprint, that of the edited text, likenesses, containment and estimated counts."""
    dealt, along = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = dealt.withColumn("_next", F.lead("text").over(along))
    df = df.withColumn("_edited", F.when(F.col("own"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))))
    df = with_sketch(df.drop("_next"), "text", "sketch", k, width).withColumn("_next_sketch", F.lead("sketch").over(along)).filter("own")
    df = with_sketch(df, "_edited", "edited_sketch", k, width)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("_next_sketch")
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"),
        containment(a, b, k).alias("contained_in_edited"),
        distinct_count(a, k).alias("n_shingles"),
    )


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
