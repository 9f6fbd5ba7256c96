"""Corpora that grow: files are read a few at a time, and each batch's counts are merged once by its number.

A batch is a table of sums by key in a folder named by its number. Running a batch again replaces its folder; a batch
that is part of a merged base already is left out. From time to time all batches so far become one base. The folder's
newest base and the batches after it add up to the whole, whatever a broken run has left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import terms
from spanloom.plans.tables import cut, remove, remove_path


class BatchSums:
    """Sums by key over numbered batches, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str], every: int = 8) -> None:
        self.spark, self.path, self.keys, self.sums, self.every = spark, path.rstrip("/"), keys, sums, every

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of the whole tables of a kind, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        whole = [x for x in names if x.startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return sorted(int(x.split("=")[1]) for x in whole)

    def base(self) -> int:
        """The last batch that the newest base holds; -1 without one."""
        return max(self._numbers("base"), default=-1)

    def _added(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def add(self, counts: DataFrame, number: int) -> None:
        """Puts a batch in its place. counts: keys and sums, one row a key or several."""
        if number <= self.base():
            return
        self._added([counts.select(*self.keys, *self.sums)]).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        base = self.base()
        # A base is read and written again only when a good part of what it holds has come in, so that all compactions
        # together are in proportion to the batches and not to their square.
        if len([k for k in self._numbers("batch") if k > base]) >= max(self.every, (base + 1) // 2):
            self.compact()

    def _parts(self) -> list[str]:
        base = self.base()
        return ([f"base={base}"] if base >= 0 else []) + [f"batch={k}" for k in self._numbers("batch") if k > base]

    def read(self) -> DataFrame:
        """The sums over all batches; there must be one at least."""
        return self._added([self.spark.read.parquet(f"{self.path}/{x}") for x in self._parts()])

    def compact(self) -> None:
        """All batches so far as one base; what it holds goes when it is whole."""
        parts = self._parts()
        last = max(int(x.split("=")[1]) for x in parts)
        if parts == [f"base={last}"]:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base={last}")
        for kind in ("base", "batch"):
            for k in self._numbers(kind):
                if k < last or (kind == "batch" and k == last):
                    remove_path(self.spark, f"{self.path}/{kind}={k}")


class CorpusBatches:
    """Element frequencies and the corpus' sizes by source, kept up to date by a stream of document files."""

    def __init__(self, spark: SparkSession, path: str, every: int = 8) -> None:
        self.path = path.rstrip("/")
        self.elements = BatchSums(spark, f"{self.path}/elements", ["element"], ["collection_freq", "span_freq"], every)
        self.sizes = BatchSums(spark, f"{self.path}/sizes", ["source"], ["n_docs", "n_spans", "n_tokens"], every)

    def merge(self, docs: DataFrame, number: int) -> None:
        """One batch of documents: doc_id, text, source."""
        made = cut(terms.tokenised(docs, phrases=False).withColumnRenamed("elements", "tokens"))
        self.elements.add(terms.frequencies(terms.with_phrases(made)), number)
        spans = made.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.size("tokens")).alias("n_tokens"))
        some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        self.sizes.add(docs.join(spans, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), some("n_spans"), some("n_tokens")), number)
        remove(made)

    def follow(self, files: DataFrame) -> None:
        """Merges all batches that a stream of documents has now; started again, it goes on behind the last one."""
        query = files.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def rows_a_file(n: int, files: int, batches: int = 20, least: int = 100) -> int:
    """How many rows a file gets so that n rows make about so many batches of so many files, each of some rows at least."""
    return max(least, -(-n // (files * batches)))


def document_files(spark: SparkSession, folder: str, schema: str, at_once: int = 5) -> DataFrame:
    """A folder of Parquet files as a stream of so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(folder)
