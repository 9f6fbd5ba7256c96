"""Periodic runs of words by Stoye and Gusfield's search for branching tandem repeats in a suffix tree.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least `times` periods and
`least` words. For a batch of documents a suffix tree is built from a suffix array by prefix doubling: ranks of all
prefixes of 2^k words, in which only suffixes that still have equals are sorted again. Words are numbered apart for
each document, so no common prefix crosses from one to another, and copies of a document cost nothing extra. The tree's
inner nodes are the intervals of the longest common prefixes of neighbours, and their children the parts between
neighbours with exactly the node's depth.

At a node of depth q a leaf i is the start of a branching tandem repeat of length 2q if i + q is another leaf of the
node under a different child: the two share q words and not one more. All such pairs are found from the leaf lists of
all children but the largest, each leaf looking for i + q and i - q by its place in the suffix array, so a leaf is
listed only as often as its subtree is at most half of its parent's: n log n in all. Each repeat is then rotated to
the left as far as words q apart are equal, by the ranks again, in steps of powers of two. What rotation reaches is a
maximal run; repeats of a multiple of the period reach the same stretch, and the smallest period stays.

Documents are independent rows, so nothing is shuffled. A task holds the tree of a batch of at most `words_at_once`
words, or of one longer document: some thirty numbers a word.

Defined cases: null and empty texts have no words and no runs; a null id is edited by no rule of the query; repeated
rows give repeated results; empty tables give empty results; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common

RUNS = "array<struct<start: long, length: long, period: long>>"


class Suffixes:
    """Suffix array of numbered words, ranks of prefixes by powers of two, and common prefixes of neighbours.

    Word numbers of different documents are different, so that no two suffixes agree across a document's end.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        fresh = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
        #: For each place the first level at which a suffix differs from the one before it.
        self.level = np.where(fresh, 0, -1).astype(np.int8)
        self.ranks = [self._ranked(order, np.flatnonzero(fresh), n)]
        width = 1
        while len(open_ := np.flatnonzero(~fresh)):
            # All places of groups that are not single: those that equal the one before, and the ones they equal.
            held = np.union1d(open_, open_ - 1)
            rank, at = self.ranks[-1], order[held]
            key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at + width, n)] + 1
            turn = np.argsort(key, kind="stable")
            order[held], key = at[turn], key[turn]
            split = held[1:][(key[1:] != key[:-1]) & ~fresh[held[1:]]]
            fresh[split] = True
            self.level[split] = len(self.ranks)
            self.ranks.append(self._ranked(order, np.flatnonzero(fresh), n))
            width *= 2
        self.order, self.place = order, self.ranks[-1]
        self.common = self._common()

    @staticmethod
    def _ranked(order: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
        """The first place of each suffix's group; the empty suffix behind the last one has -1."""
        rank = np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        return rank

    def _common(self) -> np.ndarray:
        """Longest common prefix of each suffix with the one before it, from the level that tells them apart downwards."""
        found = np.where(self.level > 0, 1 << np.maximum(self.level - 1, 0).astype(np.int64), 0)
        for k in range(len(self.ranks) - 2, -1, -1):
            at = np.flatnonzero(self.level > k + 1)
            a, b = self.order[at] + found[at], self.order[at - 1] + found[at]
            n = len(self.order)
            same = (a < n) & (b < n) & (self.ranks[k][np.minimum(a, n)] == self.ranks[k][np.minimum(b, n)])
            found[at[same]] += 1 << k
        return found

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b; a < b, no prefix at hand is longer than the ranks reach."""
        steps = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - steps - (1 << k), b - steps - (1 << k)
            same = (x >= 0) & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])
            steps[same] += 1 << k
        return steps


def bounds(depth: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the last one before it of no larger depth, the next of smaller depth, and the first of its node.

    One pass with a stack, as suffix trees are read off common prefixes; depth[0] is -1 and stands for the end, too.
    """
    n = len(depth)
    before, after, first, stack = [0] * n, [n] * n, list(range(n)), [0]
    for k in range(1, n):
        d = depth[k]
        while depth[stack[-1]] > d:
            after[stack.pop()] = k
        top = stack[-1]
        before[k] = top
        if depth[top] == d:
            first[k] = first[top]
        stack.append(k)
    return np.array(before), np.array(after), np.array(first)


def branching_repeats(tree: Suffixes, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats of periods up to the one given for each position.

    Smaller half: the leaves of every child but its node's largest are listed, and each looks q ahead and q back.
    """
    n = len(tree.order)
    depth = tree.common.copy()
    depth[:1] = -1
    before, after, first = bounds(depth.tolist())
    inner = np.flatnonzero(depth > 0)
    inner = inner[depth[inner] <= longest[tree.order[inner]]]
    # The child to the left of each place of a node, and the one to the right of its last place. Children of a place are [start, end).
    node = first[inner]
    last = np.zeros(n, np.int64)
    np.maximum.at(last, node, inner)
    tail = np.unique(node)
    owner = np.concatenate((node, tail))
    start = np.concatenate((before[inner], last[tail]))
    end = np.concatenate((inner, after[tail]))
    low, high = before[owner], after[owner]
    size = end - start
    # The largest child of each node, the first one on a tie, is not listed.
    ordered = np.lexsort((-start, size, owner))
    largest = ordered[np.flatnonzero(np.append(owner[ordered[1:]] != owner[ordered[:-1]], True))] if len(ordered) else ordered
    listed = np.ones(len(owner), bool)
    listed[largest] = False
    start, size, low, high, q, end = (x[listed] for x in (start, size, low, high, depth[owner], end))
    starts, periods = [], []
    for few in blocks(size):
        rep = lambda x: np.repeat(x[few], size[few])  # noqa: E731, B023
        at = np.arange(int(size[few].sum())) - rep(np.cumsum(size[few]) - size[few] if len(few) else size[few]) + rep(start)
        leaf, far = tree.order[at], rep(q)
        for shift in (far, -far):
            other = leaf + shift
            place = tree.place[np.clip(other, 0, n - 1)]
            outside = (place < rep(start)) | (place >= rep(end))
            hit = (other >= 0) & (other < n) & (place >= rep(low)) & (place < rep(high)) & outside
            starts.append(np.minimum(leaf, other)[hit])
            periods.append(far[hit])
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def blocks(size: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Indices in order, so many at a time that their sizes add up to about `most`."""
    part = np.cumsum(size) // most
    yield from np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else ()


def runs_of(words: np.ndarray, longest: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all maximal runs, ordered by start and period."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    tree = Suffixes(words)
    start, period = branching_repeats(tree, longest)
    turned = tree.back(start, start + period)
    start, length = start - turned, 2 * period + turned
    kept = (length >= least) & (length >= times * period)
    start, length, period = start[kept], length[kept], period[kept]
    # Of one stretch the smallest period comes first.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def batch_runs(words: pa.ListArray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, starts, lengths and periods of the runs of a list of words for each document."""
    sizes = np.diff(words.offsets.to_numpy())
    flat = words.flatten()
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start, length, period = runs_of(doc * (int(numbers.max(initial=0)) + 1) + numbers, np.repeat(sizes // times, sizes), least, times)
    own = doc[start]
    return own, start - (np.cumsum(sizes) - sizes)[own], length, period


def covered(sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each word of all documents whether a run holds it after the run's first period."""
    base = (np.cumsum(sizes) - sizes)[doc] + start
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(edge, base + period, 1)
    np.add.at(edge, base + length, -1)
    return np.cumsum(edge)[:-1] > 0


def of_sizes(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def periodic_runs(docs: DataFrame, words: str = "words", carry: tuple[str, ...] = ("doc_id",), least: int = 24, times: int = 3, words_at_once: int = 1 << 18) -> DataFrame:
    """The carried columns, n_words, runs (by start, then period) and collapsed: the words outside of repeated periods, joined by a space.

    words: a column with an array of words for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            size = pc.list_value_length(batch.column(words)).to_numpy(zero_copy_only=False)
            for few in blocks(size, words_at_once):
                part = batch.slice(few[0], len(few))
                lists = part.column(words)
                sizes = size[few].astype(np.int64)
                doc, start, length, period = batch_runs(lists, least, times)
                kept = ~covered(sizes, doc, start, length, period)
                owner = np.repeat(np.arange(len(few)), sizes)[kept]
                left = of_sizes(lists.flatten().filter(pa.array(kept)), np.bincount(owner, minlength=len(few)))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield {c: part.column(f"_{c}") for c in carry} | {"n_words": sizes, "runs": of_sizes(runs, np.bincount(doc, minlength=len(few))), "collapsed": pc.binary_join(left, " ")}

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    given = docs.select(F.coalesce(words, F.array().cast("array<string>")).alias(words), *[F.col(c).alias(f"_{c}") for c in carry])
    return common.arrow_map(given, run, f"{kinds}, n_words long, runs {RUNS}, collapsed string", 2048)


def edited_words(words: Column, doc_id: Column) -> Column:
    """A tenth of the documents, chosen by CRC-32 of the id, repeat a stretch of their words from some word on to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    # Each transform of one element binds what it holds, so that a text is split and an id hashed once and not for each word.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def edited(x: Column) -> Column:
        n, g = F.size(x["words"]).cast("long"), F.floor(x["h"] / 10)
        numbers = F.struct(x["words"].alias("words"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        repeat = lambda y: F.transform(y["words"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["words"], (y["a"] + (i - y["a"]) % y["p"]).cast("int"))))
        return F.when((x["h"] % 10 == 0) & (n > 0), bound(numbers, repeat)).otherwise(x["words"])

    return bound(F.struct(words.alias("words"), h.alias("h")), edited)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.words_of(F.col("text")).alias("words"))
    found = periodic_runs(docs.select("doc_id", edited_words(F.col("words"), F.col("doc_id")).alias("words")))
    # The greatest exponent, compared exactly as fractions; runs come by start and period, so the first of equals stays.
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), greater)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    top = found.withColumn("best", best)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
