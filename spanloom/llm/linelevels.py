"""Line dedup over batches: levelled sorted runs of line hashes, compacted from time to time.

A line's key is the line without white space at both ends and with A-Z in lower case; two 64-bit hashes stand for it.
A run is a table of (hash, mark, docs): in how many documents a batch, or the batches merged into it, hold the key. It
is bucketed by hash and sorted inside its buckets, so that runs are joined and merged bucket by bucket without a
shuffle. A new batch counts its own keys, drops by an anti-join with the runs those that have reached the limit in
one of them already, and adds what is left as a run of level 0. Two runs of a level are merged into one of the next, in
which keys that reach the limit are settled, so there are never more runs than the logarithm of the batches.
`frequent()` merges what is left. What a batch costs thus depends on its own lines and, now and then, on a merge: each
count is rewritten once a level. Merges join two tables at a time: a join of three would shuffle again, and the sum
over a union of bucketed tables, which Spark 4.1 plans without a shuffle, does not bring equal buckets together.

Documents with a frequent key lose all lines that have it. Of the text only a hash per line is joined; the positions of
a document's dropped lines come back to it by id and text hash.

Counts are added up before the shuffle, so a line that a third of all documents hold is one row a task. The join with
the frequent keys has one row per key on that side, and hot keys there can be split at run time.

Defined cases: null and empty texts are one empty line, which has no key; every row is a document of its own, whether
its id is null or repeated; equal rows lose the same lines; empty tables give empty results; other columns are ignored.
A batch that is added again under its name is left out.
"""

from __future__ import annotations

import json
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common

KEY = ["hash", "mark"]


def text_lines(text: Column) -> Column:
    """The \\n-split lines; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column) -> Column:
    """For each line the two hashes of its key, null where the key is empty."""
    lines = text_lines(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(common.SPACES)))
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("hash"), F.xxhash64(F.lit(1), k).alias("mark"))))


class LineRuns:
    """Levelled runs under a folder that driver and executors share; a list of them is a small JSON file there.

    Opened again under its path, it goes on with the runs that it has. The number of buckets stays as first given.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, limit: int = 10, buckets: int | None = None):
        self.spark, self.path, self.limit = spark, path or common.new_path(spark, "runs"), limit
        known = self._read()
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (level, table folder, batch names merged into it)
        self.runs: list[list] = known["runs"] if known else []
        self.names = {}

    def _file(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs.json")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self) -> dict | None:
        fs, at = self._file()
        return json.loads("\n".join(r[0] for r in self.spark.read.text(at.toString()).collect())) if fs.exists(at) else None

    def _save(self) -> None:
        """The list is written beside the old one and takes its place by a rename, so that a broken run leaves a whole list."""
        fs, at = self._file()
        fresh = at.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode())
        out.close()
        fs.delete(at, False)
        fs.rename(fresh, at)

    def _store(self, counts: DataFrame) -> str:
        """Writes a run: a file for each bucket, which the writer sorts. counts: hash, mark, docs, dealt by bucket."""
        name, folder = f"spanloom_run_{uuid.uuid4().hex}", f"{self.path}/{uuid.uuid4().hex}"
        with common.shuffle_cleanup(self.spark):
            counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", folder).option("compression", "zstd").saveAsTable(name)
        self.names[folder] = name
        return folder

    def _run(self, folder: str) -> DataFrame:
        if folder not in self.names:
            name = f"spanloom_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, mark BIGINT, docs BIGINT) USING parquet CLUSTERED BY (hash, mark) SORTED BY (hash, mark) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            self.names[folder] = name
        return self.spark.table(self.names[folder])

    def _merged(self, one: str, other: str) -> DataFrame:
        """The counts of two runs added up, bucket by bucket."""
        more = self._run(other).withColumnRenamed("docs", "more")
        return self._run(one).join(more, KEY, "full").select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

    def _merge(self, one: list, other: list) -> None:
        """Puts the merged run in the place of two; old tables go once the new list is stored."""
        folder = self._store(self._merged(one[1], other[1]))
        self.runs = [r for r in self.runs if r not in (one, other)] + [[max(one[0], other[0]) + 1, folder, one[2] + other[2]]]
        self._save()
        self._drop(one[1])
        self._drop(other[1])

    def _drop(self, folder: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        if name := self.names.pop(folder, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, keys: DataFrame, name: str) -> None:
        """Adds a batch once. keys: keys, an array of (hash, mark) for each document, repeats and nulls included."""
        if any(name in r[2] for r in self.runs):
            return
        # Each key of a document once: neighbours of a sorted array differ. (array_distinct compares all pairs of structs.)
        fresh = lambda ks: F.filter(ks, lambda k, i: ~k.eqNullSafe(F.get(ks, i - 1)))
        once = F.get(F.transform(F.array(F.sort_array(F.array_compact("keys"))), fresh), F.lit(0))
        each = keys.select(F.explode(once).alias("k")).select("k.hash", "k.mark")
        counts = each.groupBy(*KEY).agg(F.count("*").alias("docs"))
        for _, folder, _ in self.runs:
            counts = counts.join(self._run(folder).filter(F.col("docs") >= self.limit), KEY, "left_anti")
        self.runs.append([0, self._store(counts.repartition(self.buckets, *KEY)), [name]])
        self._save()
        while pair := next(((a, b) for a in self.runs for b in self.runs if a is not b and a[0] == b[0]), None):
            self._merge(*pair)

    def frequent(self) -> DataFrame:
        """hash, mark of the keys in at least `limit` documents of all batches; the runs are one then."""
        while len(self.runs) > 1:
            self._merge(*sorted(self.runs, key=lambda r: r[0])[:2])
        if not self.runs:
            return self.spark.createDataFrame([], "hash long, mark long")
        return self._run(self.runs[0][1]).filter(F.col("docs") >= self.limit).select(*KEY)

    def remove(self) -> None:
        """Deletes all runs and the folder."""
        for r in self.runs:
            self._drop(r[1])
        self._drop(self.path)


def dropped_lines(docs: DataFrame, limit: int = 10, batches: int = 6) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left). Batches are groups of the input's partitions."""
    spark = docs.sparkSession
    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keyed = whole.select("doc_id", "text_hash", line_keys(F.col("text")).alias("keys"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    keyed, path = common.written(keyed, "keys")
    runs = LineRuns(spark, limit=limit)
    for r in sorted(r[0] for r in keyed.select("batch").distinct().collect()):
        runs.add(keyed.filter(F.col("batch") == r), f"batch {r}")
    frequent, bad = common.written(runs.frequent(), "frequent")
    runs.remove()
    lines = keyed.select("doc_id", "text_hash", F.posexplode("keys").alias("i", "k")).filter("k IS NOT NULL").select("doc_id", "text_hash", "i", "k.hash", "k.mark")
    gone = lines.join(frequent, KEY).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    gone, _ = common.written(gone, "gone")
    common.remove(spark, path)
    common.remove(spark, bad)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash"))
    # Texts are dealt by id and hash at any size: what is joined grows with the corpus, so it is never broadcast.
    own = whole.alias("a").join(gone.hint("merge").alias("b"), same, "left").select("a.doc_id", F.struct(text_lines(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")).alias("x"))

    def rest(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        kept = F.when(F.size(x["gone"]) == 0, x["lines"]).otherwise(F.transform(left, lambda i: F.get(x["lines"], i)))
        return F.struct(F.size(x["lines"]).cast("long").alias("n_lines"), F.size(x["gone"]).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))

    # The transform of one element binds it, so that a text is split once and not for each of its lines.
    return own.select("doc_id", F.get(F.transform(F.array("x"), rest), F.lit(0)).alias("x")).select("doc_id", "x.n_lines", "x.n_dropped", "x.kept")


def op12_line_levels(spark, sf_dir: str) -> DataFrame:
    return dropped_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH whole AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lined AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM whole),
keyed AS (
  SELECT r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lined),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed),
found AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY r)
SELECT w.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM found f JOIN whole w ON f.r = w.r
"""
