"""Look-ups over results: search, pages, manifests and their verification, a registry."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scores, text
from spanloom.plans.tables import new_path


def search(found: list[tuple[str, DataFrame, str, str]], needle: str, limit: int = 20) -> DataFrame:
    """kind, id, score over several tables (kind, table, id column, text column); the best first."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), scores.search_score(F.col(t), needle).alias("score")).filter("score IS NOT NULL") for kind, df, i, t in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)


def code_search(shelf: DataFrame, needle: str, limit: int = 20, most: int = 16_000) -> DataFrame:
    """path, score: files by how often their first characters have the needle's words, by their path, and the shorter the better. shelf: path, text."""
    words = [w for w in dict.fromkeys(needle.lower().split())]
    found = F.size(F.filter(text.word_characters(F.substring("text", 1, most)), lambda x: x.isin(*words)))
    hits = sum((F.lower("path").contains(w).cast("int") for w in words), F.lit(0))
    scored = shelf.select("path", found.alias("overlap"), hits.alias("hits"), F.octet_length("text").alias("size")).filter("overlap > 0")
    return scored.select("path", scores.code_score(F.col("overlap"), F.col("hits"), F.col("size")).alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    """path, size_bytes, sha256 of each content."""
    return df.select(F.col(key).cast("string").alias("path"), F.octet_length(content).alias("size_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def verify(said: DataFrame, found: DataFrame) -> DataFrame:
    """path, status of each row of a manifest against what is there: ok, missing, size or hash."""
    here = found.select("path", F.col("size_bytes").alias("size_"), F.col("sha256").alias("sha_"))
    status = F.when(F.col("size_").isNull(), "missing").when(F.col("size_") != F.col("size_bytes"), "size").when(F.col("sha_") != F.col("sha256"), "hash").otherwise("ok")
    return said.join(here, "path", "left").select("path", status.alias("status"))


def bucket(path: Column, digits: int) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, digits)


def tree(files: DataFrame, depth: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, node, hash, n_files: a Merkle tree over files (path, sha256), one for each value of `by`.

    A file's place is the first `depth` hex digits of its path's hash, so leaves are alike in size, and each node above
    is the hash of at most sixteen hashes below. Lists are as long as a leaf: the depth is to be chosen so that
    16 ** depth leaves hold all files. Level 0 has the root.
    """
    said = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "sha256"))), ",")
    level = files.groupBy(*by, bucket(F.col("path"), depth).alias("node")).agg(F.sha2(said.cast("binary"), 256).alias("hash"), F.count("*").alias("n_files"))
    levels = [level]
    for digits in range(depth - 1, -1, -1):
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy(*by, F.substring("node", 1, digits).alias("node")).agg(F.sha2(below.cast("binary"), 256).alias("hash"), F.sum("n_files").alias("n_files"))
        levels.append(level)
    whole = levels[0].withColumn("level", F.lit(depth))
    for k, level in enumerate(levels[1:], 1):
        whole = whole.unionByName(level.withColumn("level", F.lit(depth - k)))
    return whole.select(*by, "level", "node", "hash", "n_files")


def verify_tree(said: DataFrame, found: DataFrame, said_tree: DataFrame, found_tree: DataFrame, depth: int = 3) -> DataFrame:
    """path, status of the files that differ: missing, added, size or hash.

    It descends from the roots, level by level, only where hashes differ, and compares the files of the leaves that it
    ends in. files: path, size_bytes, sha256; trees of the same depth without `by`.
    """
    differ = None
    for level in range(depth + 1):
        a, b = (t.filter(F.col("level") == level).select("node", F.col("hash").alias(c)) for t, c in ((said_tree, "a"), (found_tree, "b")))
        if differ is not None:
            up = differ.select(F.col("node").alias("up"))
            a, b = (t.join(up, F.substring("node", 1, level - 1) == F.col("up"), "left_semi") for t in (a, b))
        differ = a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    inside = lambda df: df.join(differ, bucket(F.col("path"), depth) == F.col("node"), "left_semi")
    here = inside(found).select("path", F.col("size_bytes").alias("size_"), F.col("sha256").alias("sha_"))
    status = F.when(F.col("sha_").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("size_") != F.col("size_bytes"), "size").when(F.col("sha_") != F.col("sha256"), "hash")
    return inside(said).join(here, "path", "full").select("path", status.alias("status")).filter("status IS NOT NULL")



class Registry:
    """Corpora, runs and artifacts as logs of JSON records in a folder: a change is one more record, the newest of a key holds.

    Registering the same again changes nothing. Any session that names the folder sees the same tables.
    """

    SCHEMAS = {"corpus": "corpus_id string, name string, fingerprint string", "runs": "run_id string, corpus_id string, status string, export_key string", "artifacts": "artifact_id string, run_id string, kind string, name string"}

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_path(spark)

    def table(self, name: str) -> DataFrame:
        """The newest record of each key, and when it came (`created`: the first one)."""
        schema = f"{self.SCHEMAS[name]}, seq long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        log = self.spark.read.schema(schema).json(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)
        key, *rest = [c for c in log.columns if c != "seq"]
        newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min("seq").alias("created"))
        return newest.select(key, "r.*", "created")

    def put(self, name: str, *row: str | None) -> None:
        new = self.spark.createDataFrame([(*row, time.time_ns())], f"{self.SCHEMAS[name]}, seq long")
        new.coalesce(1).write.mode("append").json(f"{self.folder}/{name}")

    def get(self, name: str, key: str) -> dict | None:
        found = self.table(name)
        row = found.filter(F.col(found.columns[0]) == key).head()
        return row.asDict() if row else None

    def get_or_create_corpus(self, name: str, fingerprint: str) -> str:
        if row := self.table("corpus").filter(F.col("fingerprint") == fingerprint).select("corpus_id").head():
            return row[0]
        self.put("corpus", fingerprint[:12], name, fingerprint)
        return fingerprint[:12]

    def create_run(self, run_id: str, corpus_id: str) -> str:
        if self.get("runs", run_id) is None:
            self.put("runs", run_id, corpus_id, "running", None)
        return run_id

    def set_status(self, run_id: str, status: str, export_key: str | None = None) -> None:
        if (row := self.get("runs", run_id)) is None:
            raise KeyError(run_id)
        self.put("runs", run_id, row["corpus_id"], status, export_key or row["export_key"])

    def register_artifact(self, run_id: str, kind: str, name: str) -> str:
        key = f"{run_id}:{kind}:{name}"
        if self.get("artifacts", key) is None:
            self.put("artifacts", key, run_id, kind, name)
        return key

    def listing(self, name: str) -> DataFrame:
        """The newest first."""
        found = self.table(name)
        return found.orderBy(F.desc("created"), found.columns[0])
