"""Reading and writing corpora: folders of text, tables with missing columns, JSON vectors, notes, archives of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import scores, text

TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".tex")
TABLE_SUFFIXES = (".csv", ".json", ".txt")


def suffix_of(path):
    return F.lower(F.regexp_extract(text.base_name(path), "(\\.[^.]+)$", 1))


def is_text(path):
    return suffix_of(path).isin(*TEXT_SUFFIXES)


def is_table(path):
    return suffix_of(path).isin(*TABLE_SUFFIXES)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, text of every file below a folder, cleaned by kind; binary kinds have empty texts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind, body = text.file_kind(F.col("path")), F.decode("content", "UTF-8")
    clean = F.when(kind == "pdf", "").when(kind == "latex", text.strip_latex(body)).when(kind == "html", text.strip_html(body)).when(kind == "python", F.array_join(text.comments(body), "\n")).when(kind == "c_like", F.array_join(text.comments(body, "c"), "\n")).otherwise(text.squeeze(body))
    return raw.select("path", kind.alias("kind"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), clean.alias("text"))


def table(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """A table with the columns of a schema: missing ones are null, values that do not fit too."""
    reader = spark.read.option("header", "true")
    df = reader.csv(path) if form == "csv" else spark.read.json(path) if form == "json" else spark.read.parquet(path)
    wanted = T._parse_datatype_string(schema)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """A JSON text column as an array of doubles; no other literal is evaluated."""
    return df.withColumn(column, F.from_json(column, "array<double>"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, links, body of Markdown notes with front matter."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", "(?s)\\A---\\n(.*?)\\n---", 1)
    return raw.select("path", F.regexp_extract(head, "(?m)^title:\\s*(.*)$", 1).alias("title"), F.regexp_extract_all("value", F.lit("\\[\\[([^\\]|]+)"), 1).alias("links"), F.regexp_replace("value", "(?s)\\A---\\n.*?\\n---\\n?", "").alias("body"))


def note_links(found: DataFrame) -> DataFrame:
    """source, target (paths): links between notes, resolved by file name or by title; links that lead nowhere are left out. found: path, title, links."""
    name = F.regexp_replace(text.base_name(F.col("path")), "\\.[^.]+$", "")
    known = found.select(F.col("path").alias("target"), F.explode(F.array_distinct(F.array_compact(F.array(name, F.when(F.col("title") != "", F.col("title")))))).alias("link"))
    return found.select(F.col("path").alias("source"), F.explode("links").alias("link")).join(known, "link").select("source", "target").distinct()


def labels(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """key, label of a label file: the key is span_id or element, the label the first column there is of four names."""
    raw = spark.read.option("header", "true").csv(path) if form == "csv" else spark.read.json(path)
    names = [c for c in ("label", "epistemic_label", "truth_label", "class") if c in raw.columns]
    key = next((c for c in ("span_id", "element") if c in raw.columns), None)
    if not names or key is None:
        raise ValueError("a label file has span_id or element, and a label column")
    return raw.select(F.col(key).cast("string").alias("key"), scores.canonical_label(F.coalesce(*names)).alias("label"))


def write_edges(edges: DataFrame, path: str) -> None:
    """A sorted CSV table; range partitions keep the order over several files."""
    edges.orderBy(F.desc("weight"), "source", "target").write.mode("overwrite").option("header", "true").csv(path)


def write_compounds(compounds: DataFrame, path: str) -> None:
    """One JSON object for each compound."""
    compounds.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
