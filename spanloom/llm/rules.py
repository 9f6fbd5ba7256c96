"""Quality rules in DataFrame operations only: base counts of each document and cross-document line frequency.

Lines are normalised (lower case, white space runs as one space, trimmed) and hashed. A line that occurs in more
than `max_docs` documents of a host is removed there, all its occurrences. Documents of a host with equal texts count
as one, so that copies of a document do not use up its own lines. The limit is a number of documents, as published
for web corpora (six in a bucket): it does not rise with the host, so boilerplate of large hosts goes too. A
document whose removed lines held more than `depleted` of its words, or that has fewer than `min_words` left, is
rejected. The text is scanned once; what is kept of it is a row per document with its line hashes. Counts per
(host, line) are made of distinct (host, line, text) first, so a hot line is spread by its texts, and the join back is
on (host, line) with one row per key on the counted side, so that a hot host or line can be split at run time.

Defined cases: null texts have no words and fail the base rules; a null host is a host of its own; repeated rows
are documents of their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common

SYMBOLS = "[#*$%&|<>]"


def with_repeats(df: DataFrame, words: str = "words", width: int = 3, few: int = 24) -> DataFrame:
    """Adds n_repeat_words: the words inside windows of `width` words that the text holds twice or more.

    Only texts with a repeated window hash are looked at. If few hashes are repeated, the windows are searched for
    them; else a sorted list of longs, the upper bits of a window's hash over its position, brings equal windows
    together, and the whole hashes of neighbours decide. Both give the positions of the repeated windows.
    """
    long = lambda x: x.cast("long")
    df = df.withColumn("_h", common.windows_of(words, width))
    df = df.withColumn("_many", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    df = df.withColumn("_s", F.when(F.col("_many"), F.sort_array("_h"))).withColumn("_bits", F.length(F.bin(long(F.size("_h")))))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, k: x == F.get("_s", k + 1))))
    bits, lift = F.col("_bits"), lambda x, n: F.call_function("shiftleft", x, n)
    packed = F.sort_array(F.transform("_h", lambda x, i: lift(F.call_function("shiftright", x, bits), bits).bitwiseOR(long(i))))
    df = df.withColumn("_s", F.when(F.size("_d") > few, packed))
    at = lambda x: x.bitwiseAND(lift(long(F.lit(1)), bits) - 1).cast("int")

    def doubled(x: Column, k: Column) -> Column:
        own = F.get("_h", at(x))
        return F.coalesce(F.greatest(*[own == F.get("_h", at(F.get("_s", k + j))) for j in (-2, -1, 1, 2)]), F.lit(False))

    found = F.array_compact(F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)))
    many = F.sort_array(F.transform(F.filter("_s", doubled), at))
    df = df.withColumn("_p", F.when(F.size("_d") > few, many).when(F.size("_d") > 0, found))
    fresh = F.transform("_p", lambda p, k: F.least(F.lit(width), F.coalesce(F.get("_p", k + 1) - p, F.lit(width))))
    total = F.aggregate(fresh, long(F.lit(0)), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, long(F.lit(0)))).drop("_h", "_many", "_s", "_bits", "_d", "_p")


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per document: its counts, a hash of its text, and the hash and words of each normalised line that has words."""
    df = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("null")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns(
        {
            "words": common.words_of(F.col("text")),
            "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "_normal": F.array_remove(F.transform(F.split(F.lower(F.regexp_replace("text", "[\\x20\\x09\\x0B-\\x0D]+", " ")), "\n"), lambda x: F.trim(x)), ""),
        }
    )
    df = with_repeats(df)
    long = lambda x: x.cast("long")
    return df.select(
        "doc_id",
        "host",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        F.xxhash64("text").alias("text_hash"),
        F.transform("_normal", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"))).alias("lines"),
    )


def frequent_lines(counted: DataFrame, max_docs: int) -> DataFrame:
    """(host, line) of the lines in more than max_docs different documents of a host."""
    seen = counted.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return seen.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs).select("host", "line")


def line_rules(docs: DataFrame, host: str = "source", max_docs: int = 6, depleted: float = 0.5, min_words: int = 50) -> DataFrame:
    """doc_id, counts, base_failed, n_removed_words, kept."""
    counted = base_counts(docs, host).withColumn("row", F.monotonically_increasing_id())
    counted, _ = common.written(counted, "lines")
    bad = frequent_lines(counted, max_docs)
    lines = counted.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    removed = lines.join(bad, ["host", "line"]).groupBy("row").agg(F.sum("words").cast("long").alias("n_removed_words"))
    df = counted.drop("lines").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    drained = (F.col("n_removed_words") > depleted * F.col("n_words")) | (F.col("n_words") - F.col("n_removed_words") < min_words)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~drained).drop("row", "host", "text_hash")


def op5_line_frequency(spark, sf_dir: str) -> DataFrame:
    return line_rules(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


OP5_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM worded),
windows AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
doubled AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM windows WHERE third IS NOT NULL) t
  WHERE n > 1),
repeats AS (
  SELECT doc_id, CAST(count(DISTINCT pos + k) AS BIGINT) AS n_repeat_words
  FROM doubled, (SELECT unnest([0, 1, 2]) AS k) s GROUP BY doc_id),
lined AS (SELECT doc_id, host, md5(text) AS digest, unnest(lines) AS line FROM worded),
normal AS (
  SELECT doc_id, host, digest, lower(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM lined),
frequent AS (SELECT host, line FROM normal GROUP BY host, line HAVING count(DISTINCT digest) > 6),
removed AS (
  SELECT n.doc_id, CAST(sum(n.words) AS BIGINT) AS n_removed_words FROM normal n JOIN frequent f ON n.host = f.host AND n.line = f.line GROUP BY n.doc_id),
counted AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(x.n_removed_words, 0) AS n_removed_words
  FROM worded w LEFT JOIN repeats r ON w.doc_id = r.doc_id LEFT JOIN removed x ON w.doc_id = x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_removed_words > 0.5 * n_words OR n_words - n_removed_words < 50) AS kept
FROM counted
"""
