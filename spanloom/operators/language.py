"""Element sequences and an n-gram model: a named substitute for a neural one, which needs libraries not at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.tables import cut, ranked

FIRST_ID = 4  # fixed: 0 pad, 1 begin, 2 end, 3 unknown


def sequences(words: DataFrame, length: int = 128, min_freq: int = 2, least: int = 4) -> DataFrame:
    """doc_id, chunk, ids: chunks of word ids in order, begin and end marks around. words: doc_id, place, word."""
    freq = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_freq)
    ids = ranked(freq, F.desc("n"), F.col("word")).withColumn("id", F.col("place") + FIRST_ID - 1)
    known = words.join(ids.select("word", "id"), "word", "left").withColumn("id", F.coalesce("id", F.lit(3)))
    chunked = known.groupBy("doc_id", F.floor(F.col("place") / length).cast("int").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    return chunked.filter(F.size("ids") >= least).withColumn("ids", F.concat(F.array(F.lit(1)), "ids", F.array(F.lit(2))))


def bigram_perplexity(words: DataFrame, k: float = 1.0) -> DataFrame:
    """doc_id, perplexity under an add-k bigram model of all documents; counts are summed before any shuffle."""
    pairs = words.withColumn("next", F.lead("word").over(Window.partitionBy("doc_id").orderBy("place"))).filter("next IS NOT NULL")
    counts = pairs.groupBy("word", "next").agg(F.count("*").alias("n"))
    totals = counts.groupBy("word").agg(F.sum("n").alias("total"))
    size = words.agg(F.countDistinct("word").alias("v"))
    lp = F.log((F.col("n") + k) / (F.col("total") + k * F.col("v")))
    return pairs.join(counts, ["word", "next"]).join(totals, "word").crossJoin(F.broadcast(size)).groupBy("doc_id").agg(F.exp(-F.avg(lp)).alias("perplexity"), F.count("*").alias("n_pairs"))


DISCOUNT = 0.75


def trigrams(words: DataFrame) -> DataFrame:
    """doc_id, g1, g2, g3: three words in a row of a document. words: doc_id, place, word."""
    w = Window.partitionBy("doc_id").orderBy("place")
    return words.select("doc_id", F.col("word").alias("g1"), F.lead("word", 1).over(w).alias("g2"), F.lead("word", 2).over(w).alias("g3")).filter("g3 IS NOT NULL")


class KneserNey:
    """An interpolated Kneser-Ney model of order three with one discount, as tables of counts.

    The middle order counts in how many different contexts a pair occurs, the lowest one after how many different words
    a word does; what the discount takes is given to the order below, and at the end to all known words and one unknown
    alike. Counts are sums by key, made before the shuffle, and each order is made of the one above.
    """

    def __init__(self, grams: DataFrame, discount: float = DISCOUNT) -> None:
        self.d = discount
        self.three = cut(grams.groupBy("g1", "g2", "g3").agg(F.count("*").alias("n3")))
        self.two = cut(self.three.groupBy("g2", "g3").agg(F.count("*").alias("n2")))
        self.one = cut(self.two.groupBy("g3").agg(F.count("*").alias("n1")))
        self.after_two = self.three.groupBy("g1", "g2").agg(F.sum("n3").alias("sum3"), F.count("*").alias("kinds3"))
        self.after_one = self.two.groupBy("g2").agg(F.sum("n2").alias("sum2"), F.count("*").alias("kinds2"))
        self.all = self.one.agg(F.sum("n1").alias("sum1"), F.count("*").alias("kinds1"))

    def scored(self, grams: DataFrame) -> DataFrame:
        """Adds p, the probability of the third word after the first two; known or not, it is above 0."""
        left = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)) - self.d, F.lit(0.0))
        lower = (left("n1") + self.d * F.col("kinds1") / (F.col("kinds1") + 1)) / F.col("sum1")
        middle = F.when(F.col("sum2").isNull(), F.col("p1")).otherwise((left("n2") + self.d * F.col("kinds2") * F.col("p1")) / F.col("sum2"))
        upper = F.when(F.col("sum3").isNull(), F.col("p2")).otherwise((left("n3") + self.d * F.col("kinds3") * F.col("p2")) / F.col("sum3"))
        known = grams.join(self.one, "g3", "left").join(self.two, ["g2", "g3"], "left").join(self.three, ["g1", "g2", "g3"], "left").join(self.after_one, "g2", "left").join(self.after_two, ["g1", "g2"], "left")
        # One row is broadcast.
        return known.crossJoin(F.broadcast(self.all)).withColumn("p1", lower).withColumn("p2", middle).withColumn("p", upper).select(*grams.columns, "p")

    def perplexity(self, grams: DataFrame) -> DataFrame:
        """doc_id, perplexity, n_words: of the third words of each document."""
        return self.scored(grams).groupBy("doc_id").agg(F.exp(-F.avg(F.log("p"))).alias("perplexity"), F.count("*").alias("n_words"))

    def suggestions(self, starts: DataFrame, steps: int = 2, beam: int = 3) -> DataFrame:
        """g1, g2, place, words, score: for each start of two words the best continuations by a beam search over seen trigrams.

        Only a context's `beam` best words can be in the beam, so a step joins as many rows for each one in it. Logs are
        rounded to nine digits, so that ties are ties wherever it runs; the least words win them. starts: g1, g2.
        """
        best = Window.partitionBy("g1", "g2").orderBy(F.desc("lp"), "g3")
        seen = self.scored(self.three.select("g1", "g2", "g3")).select("g1", "g2", "g3", F.round(F.log("p"), 9).alias("lp"))
        after = cut(seen.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).select(F.col("g1").alias("u"), F.col("g2").alias("v"), F.col("g3").alias("next"), "lp"))
        state = starts.select("g1", "g2", F.col("g1").alias("u"), F.col("g2").alias("v"), F.lit("").alias("words"), F.lit(0.0).alias("score"))
        order = Window.partitionBy("g1", "g2").orderBy(F.desc("score"), "words")
        for _ in range(steps):
            longer = state.join(after, ["u", "v"]).select("g1", "g2", F.col("v").alias("u"), F.col("next").alias("v"), F.ltrim(F.concat_ws(" ", "words", "next")).alias("words"), F.round(F.col("score") + F.col("lp"), 9).alias("score"))
            state = longer.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= beam)
        return state.select("g1", "g2", "place", "words", "score")
