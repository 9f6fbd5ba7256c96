"""A training corpus from raw documents: quality, near duplicates, repeated passages, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of their input, whatever the others are named. The caller owns
what stages write to the shared folder; a document without an id is never taken for a copy of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common, crf, mixing, pieces, simhash, suffixes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it is fitted on labelled documents of the input.

    Texts are all that is looked at: null ids, repeated rows and any other columns stay as they are.
    """
    model = crf.train(docs, common.table(spark, sf_dir, "labels"))
    whole = docs.select("text", F.struct(*map(common.named, docs.columns)).alias("document"))
    return crf.scored(whole, model).filter(F.col("_crf_score") >= crf.THRESHOLD).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, resemblance 0.8 or more) the document with the smallest id stays.

    Rows with the same id and text are one document; different texts under one id are different documents, of which
    all stay that are no near duplicates. A row without an id stays.
    """
    found = simhash.similar_documents(docs).filter("stays").select("doc_id", "text_hash").distinct()
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*map(common.named, docs.columns)).alias("document"))
    stays = whole.join(found, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min("document").alias("document"))
    return stays.select("document.*").unionByName(docs.filter("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that start in an earlier document too; a document of which no word is left goes.

    Only whole characters are cut. Null ids count as larger than all others. Null texts stay null.
    """
    others = {f"carried_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    carried = docs.select("doc_id", "text", F.col("text").isNull().alias("was_null"), *[common.named(c).alias(k) for k, c in others.items()])
    cut = suffixes.repeated_passages(carried, kept=True, carry=("was_null", *others), characters=True)
    text = cut.withColumn("text", F.when(~F.col("was_null"), F.col("kept").cast("string")))
    left = text.filter("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").withColumn("n_chars", F.length("text").cast("long"))
    at = {c: k for k, c in others.items()}
    return left.select(*[F.col(at.get(c, c)).cast(t).alias(c) for c, t in docs.dtypes])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents to reach the sources' target weights; the last one of a source is cut behind its budget's words.

    Null ids and sources are mixed like others; a document without words goes.
    """
    rows, _ = common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*map(common.named, docs.columns)).alias("document")), "numbered")
    taken = mixing.mix(rows.select("row", "document.doc_id", "document.text", "document.source"), carry=["row"]).filter("taken > 0").select("row", "size", "taken")
    times = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))
    copies = rows.join(taken, "row").withColumn("copy", F.explode(times))
    words, text = F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("document.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), 0), F.lit(1), words.cast("int")), "")
    cut = copies.withColumn("text", F.when(words < F.col("size"), first).otherwise(text))
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[now.get(c, F.col("document")[c]).cast(t).alias(c) for c, t in docs.dtypes])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's best segmentation and the scores of the next ones."""
    return pieces.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixture", mixture), ("pieces", encoded)]
#: Hashes, a fitted model and segmentation are not to be had in SQL; tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = common.written(docs, name)
    return docs
