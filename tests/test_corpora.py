"""Phrases in texts, growing corpora, the corpus data source, trees of hashes, a Kneser-Ney model."""

import math
import os
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import language, phrases, service, terms
from spanloom.sources import scan, sinks
from spanloom.streaming import batches

TEXTS = ["The sum of the parts", "über summ, SUM OF it", "sum_of no; sum  of two", "a sum of", None, "the of-the sum", "sum of " * 300]


def test_phrases_in_texts(spark):
    targets = ["sum", "sum of", "of the", "the", "ber", "x", "parts"]
    spans = spark.createDataFrame([(k // 2, k % 2, t) for k, t in enumerate(TEXTS * 3)], "doc_id long, position int, span string").repartition(5)
    found = {(r.element, r.place): (r.doc_id, r.position) for r in phrases.text_examples(spans, spark.createDataFrame([(t,) for t in targets], "element string")).collect()}
    want = {}
    for t in targets:
        if len(t) > 1:
            at = [(k // 2, k % 2) for k, s in enumerate(TEXTS * 3) if s and re.search(r"\b" + re.escape(t) + r"\b", s.lower())]
            want |= {(t, place): x for place, x in enumerate(sorted(at)[:3], 1)}
    assert found == want
    with pytest.raises(ValueError, match="more than 2"):
        phrases.text_examples(spans, spark.createDataFrame([("aa",), ("bb",), ("cc",)], "element string"), most=2)
    assert phrases.text_examples(spans, spark.createDataFrame([], "element string")).count() == 0


def docs(spark, ids):
    return spark.createDataFrame([(k, f"common words of number {'abcdefghij'[k % 10] * 4} here\nanother line of text follows", f"s{k % 2}") for k in ids], "doc_id long, text string, source string")


def element_rows(df):
    return sorted(map(tuple, df.select("element", "collection_freq", "span_freq").collect()))


def test_batches_merge_once(spark, tmp_path):
    kept = batches.CorpusBatches(spark, str(tmp_path / "kept"), every=3)
    for k in range(5):
        kept.merge(docs(spark, range(4 * k, 4 * k + 4)), k)
        kept.merge(docs(spark, range(4 * k, 4 * k + 4)), k)  # run again, before or after it was merged into a base
    assert kept.elements.base() == 2
    kept.merge(docs(spark, range(4)), 1)
    want = terms.frequencies(terms.tokenised(docs(spark, range(20))))
    assert element_rows(kept.elements.read()) == element_rows(want)
    assert sorted(map(tuple, kept.sizes.read().select("source", "n_docs", "n_spans").collect())) == [("s0", 10, 20), ("s1", 10, 20)]
    # A broken run leaves an unfinished base behind: it is not looked at.
    os.makedirs(tmp_path / "kept/elements/base=4/_temporary")
    assert element_rows(kept.elements.read()) == element_rows(want)
    kept.elements.compact()
    assert kept.elements._parts() == ["base=4"] and element_rows(kept.elements.read()) == element_rows(want)


def test_stream_of_files_goes_on(spark, tmp_path):
    folder, kept = str(tmp_path / "docs"), batches.CorpusBatches(spark, str(tmp_path / "kept"))
    stream = lambda: batches.document_files(spark, folder, "doc_id long, text string, source string", 2)
    docs(spark, range(30)).repartition(5).write.parquet(folder)
    kept.follow(stream())
    assert len(kept.elements._numbers("batch")) == 3
    docs(spark, range(30, 40)).coalesce(1).write.mode("append").parquet(folder)
    kept.follow(stream())
    kept.follow(stream())
    assert element_rows(kept.elements.read()) == element_rows(terms.frequencies(terms.tokenised(docs(spark, range(40)))))


def test_corpus_data_source(spark, tmp_path):
    folder = str(tmp_path / "files")
    rows = [(f"d{k % 3}/f{k}.{('txt', 'MD', 'bin')[k % 3]}", "é" * k) for k in range(12)] + [("no_suffix", "x"), ("d0/empty.txt", None)]
    assert sinks.write_files(spark.createDataFrame(rows, "path string, text string"), folder) == 14
    open(f"{folder}/d0/broken.txt", "wb").write(b"a\xff")
    scan.register(spark)
    read = lambda **o: spark.read.format("corpus_files").options(**o).load(folder)
    whole = {r.path: (r.suffix, r.size_bytes, r.text) for r in read().collect()}
    assert whole == {p: ("." + p.rsplit(".", 1)[1].lower() if "." in p else "", len((t or "").encode()), t or "") for p, t in rows} | {"d0/broken.txt": (".txt", 2, "a�")}
    assert {r.path for r in read(suffixes="md, .bin").collect()} == {p for p in whole if p.lower().endswith((".md", ".bin"))}
    assert [r.path for r in read(max_docs="4").collect()] == sorted(whole)[:4]
    parts = read(partition_bytes="10")
    assert parts.rdd.getNumPartitions() > 5 and parts.count() == 15
    assert spark.read.format("corpus_files").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="not a path below"):
        sinks.write_files(spark.createDataFrame([("../x", "")], "path string, text string"), folder)


def test_corpus_stream(spark, tmp_path):
    folder, out = str(tmp_path / "files"), str(tmp_path / "out")
    scan.register(spark)

    def run():
        spark.readStream.format("corpus_files").load(folder).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.path for r in spark.read.parquet(out).collect())

    write = lambda names: sinks.write_files(spark.createDataFrame([(n, n) for n in names], "path string, text string"), folder)
    write(["b", "a"])
    assert run() == ["a", "b"]
    time.sleep(0.05)
    write(["0"])
    assert run() == run() == ["0", "a", "b"]


def test_trees(spark):
    def manifest(texts):
        return service.manifest(spark.createDataFrame(list(texts.items()), "path string, text string"), "path", "text")

    said = {f"p/{k}": f"text {k}" for k in range(200)}
    found = dict(said)
    del found["p/7"]
    found |= {"p/9": "text 0", "p/50": "longer text", "new": "x"}
    a, b = manifest(said), manifest(found)
    differ = service.verify_tree(a, b, service.tree(a, 2), service.tree(b, 2), 2)
    assert sorted(map(tuple, differ.collect())) == [("new", "added"), ("p/50", "size"), ("p/7", "missing"), ("p/9", "hash")]
    assert service.verify_tree(a, a, service.tree(a, 2), service.tree(a, 2), 2).count() == 0
    root = lambda df: service.tree(df, 2).filter("level = 0").head()
    assert root(a).n_files == 200 and root(a).hash == root(a.repartition(7)).hash != root(b).hash


def test_kneser_ney_of_unseen_words(spark):
    """Held-out documents with unknown words, against sums in plain Python; probabilities after a context add up to 1."""
    train = [(k, i, w) for k, s in enumerate(["a b c a b d", "b c a b c", "c a a b c d"]) for i, w in enumerate(s.split())]
    held = [(9, i, w) for i, w in enumerate("a b c d z a b".split())]
    frame = lambda rows: language.trigrams(spark.createDataFrame(rows, "doc_id long, place int, word string"))
    grams = lambda rows: [tuple(w[i : i + 3]) for k in {r[0] for r in rows} for w in [[r[2] for r in rows if r[0] == k]] for i in range(len(w) - 2)]
    three = Counter(grams(train))
    two, one = Counter(), Counter()
    for _, v, w in three:
        two[v, w] += 1
    for _, w in two:
        one[w] += 1
    d, kinds, total = language.DISCOUNT, len(one), sum(one.values())

    def p(u, v, w):
        low = (max(one[w] - d, 0) + d * kinds / (kinds + 1)) / total
        after = [n for (x, _), n in two.items() if x == v]
        mid = (max(two[v, w] - d, 0) + d * len(after) * low) / sum(after) if after else low
        after = [n for (x, y, _), n in three.items() if (x, y) == (u, v)]
        return (max(three[u, v, w] - d, 0) + d * len(after) * mid) / sum(after) if after else mid

    assert sum(p("a", "b", w) for w in [*one, "unknown"]) == pytest.approx(1.0)
    model = language.KneserNey(frame(train))
    (row,) = model.perplexity(frame(held)).collect()
    want = [p(*g) for g in grams(held)]
    assert row.n_words == 5 and row.perplexity == pytest.approx(math.exp(-sum(map(math.log, want)) / 5))
    found = defaultdict(list)
    for r in model.suggestions(spark.createDataFrame([("a", "b"), ("x", "y")], "g1 string, g2 string"), steps=1).orderBy("place").collect():
        found[r.g1, r.g2].append((r.words, r.score))
    best = sorted(((round(math.log(p("a", "b", w)), 9), w) for u, v, w in three if (u, v) == ("a", "b")), key=lambda x: (-x[0], x[1]))
    assert dict(found) == {("a", "b"): [(w, pytest.approx(s, abs=1e-8)) for s, w in best]}


def test_compactions_grow_with_the_batches(spark, tmp_path):
    class Counted(batches.BatchSums):
        written = 0

        def compact(self):
            super().compact()
            self.written += self.base() + 1

    kept = Counted(spark, str(tmp_path / "sums"), ["k"], ["n"], every=1)
    for k in range(24):
        kept.add(spark.createDataFrame([(k % 3, 1)], "k long, n long").coalesce(1), k)
    assert sorted(map(tuple, kept.read().select("k", "n").collect())) == [(0, 8), (1, 8), (2, 8)]
    # All batches so far were written again with each one: 300 in all.
    assert kept.written <= 3 * 24


def test_a_larger_corpus_has_no_more_batches():
    for n in (10, 1_000, 12_345, 600_000, 36_000_000):
        rows = batches.rows_a_file(n, 8)
        assert -(-n // (rows * 8)) <= 20 and rows >= 100
