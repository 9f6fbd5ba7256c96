"""Exact removal of repeated passages by a blockwise suffix array with a difference cover.

A byte goes if a string of `depth` (50) bytes that covers it also starts in a document with a smaller id.

Which suffixes meet. The minimizer of a window (a string of `depth` bytes) is the least hash of its 18-grams. Equal
windows have equal minimizers, so windows are dealt to suffix buckets by them; windows in a row with the same
minimizer travel as one segment. Documents are packed into blocks of about 2 MB. Per block, first only the distinct
minimizers are counted, 5 bytes each; windows whose minimizer is in no second document are done. Of the others each
block sends every distinct segment once, with the least and largest id that hold it.

Sorting a bucket. Suffixes of a bucket's distinct segments are sorted in parts by their first two bytes, one part
at a time, by 16 bytes directly. Longer ties are resolved by ranks of a cover sample, computed before: positions
that are 0, 1, 3 or 9 modulo 13 are ranked; any two positions have an offset below 13 that takes both into the
sample, and ranks there decide. All tied groups of like size go through one sorting network together. Neighbours in
the sorted order that share `depth` bytes are equal windows; the least id of each group goes back to the blocks
that asked, and these cut their documents. Memory is bounded by a block and a bucket; the number of buckets grows
with the text. Stages are cut by tables in the shared folder, and shuffle files go as soon as a stage is written.

Defined cases: null texts are empty; null ids count as larger than all others and not as smaller than each other;
rows that repeat an id do not remove each other; empty tables give empty results; other columns are ignored. A
document of any length is one block and is scanned in slices.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common

GRAM = 18
PERIOD, COVER = 13, (0, 1, 3, 9)
NO_ID = np.iinfo(np.int64).max
#: For each pair of residues an offset that takes both into the cover.
OFFSETS = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
SLICE = 1 << 17


def pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def words_at(data: np.ndarray, dtype: str) -> np.ndarray:
    """The eight bytes from each position as one number; behind the end there are zeros."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (n + 8 - k) // 8 * 8].view(dtype)
        out[k : k + 8 * len(part) : 8] = part
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs_of(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same minimizer: first window, how many, the minimizer. ends: where the documents end.

    Slices are small, so that all intermediate arrays stay in a core's cache.
    """
    reach = depth - GRAM + 1
    last = np.repeat((ends - depth).astype(np.int64), np.diff(np.concatenate(([0], ends))))
    starts, values = [], []
    for a in range(0, max(0, len(data) - depth + 1), SLICE):
        part = data[a : a + SLICE + depth - 1]
        n = len(part) - depth + 1
        w = words_at(part, "<u8")
        h = w[: len(part) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        h += w[8 : len(part) - GRAM + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += w[GRAM - 8 : len(part) - 7] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        have = 1
        while have < reach:
            step = min(have, reach - have)
            h = np.minimum(h[: len(h) - step], h[step:])
            have += step
        stop = last[a : a + n]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(h[1:n], h[: n - 1], out=new[1:])
        new[1:] |= stop[1:] != stop[:-1]
        # Where windows stop fitting into their document a run ends too.
        ended = np.unique(stop) + 1 - a
        new[ended[(ended >= 0) & (ended < n)]] = True
        first = np.flatnonzero(new)
        starts.append(first + a)
        values.append(h[first])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, value = np.concatenate(starts), mixed(np.concatenate(values))
    count = np.diff(np.concatenate((first, [len(data) - depth + 1])))
    keep = first <= last[first]
    return first[keep], count[keep], value[keep]


class Block:
    """Some documents, their runs, and the distinct minimizers by bucket."""

    def __init__(self, blob: bytes, n_buckets: int, depth: int, places: tuple | None = None) -> None:
        """places: where the segments are (first window, document, segment number), if that is known already."""
        self.ids, self.known, lengths, raw = unpack(blob)
        self.data, self.ends, self.depth = np.frombuffer(raw, np.uint8), np.cumsum(lengths), depth
        self.starts = self.ends - lengths
        if places:
            self.first, self.row, self.segment = places
            return
        self.first, self.count, self.value = runs_of(self.data, self.ends, depth)
        self.row = np.searchsorted(self.ends, self.first, "right")
        self.distinct, self.which = np.unique(self.value, return_inverse=True)
        self.bucket = (self.distinct % np.uint64(n_buckets)).astype(np.int64)

    def minimizers(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, numbers of its minimizers, whether two documents of the block hold each)."""
        doc = self.ids[self.row]
        least, most = np.full(len(self.distinct), NO_ID), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, self.which, doc)
        np.maximum.at(most, self.which, doc)
        order = np.argsort(self.bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.bucket[order])) + 1):
            if len(part):
                yield int(self.bucket[part[0]]), part, (least != most)[part]

    def flag(self, masks: list[tuple[int, bytes]]) -> None:
        """Keeps the runs whose minimizers are shared, and numbers their distinct segments."""
        masks, shared = dict(masks), np.zeros(len(self.distinct), bool)
        for bucket, part, _ in self.minimizers():
            if bucket in masks:
                shared[part] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(part)).astype(bool)
        keep = shared[self.which]
        self.first, self.count, self.row, self.which = self.first[keep], self.count[keep], self.row[keep], self.which[keep]
        raw, numbers = self.data.tobytes(), {}
        stops = self.first + self.count + self.depth - 1
        self.segment = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(self.first.tolist(), stops.tolist(), strict=True)], np.int64)
        self.texts = list(numbers)

    def segments(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """(bucket, numbers of its segments, least and largest id that hold each, their texts)."""
        n, doc = len(self.texts), self.ids[self.row]
        least, most, bucket = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
        np.minimum.at(least, self.segment, doc)
        np.maximum.at(most, self.segment, doc)
        bucket[self.segment] = self.bucket[self.which]
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                yield int(bucket[part[0]]), part, least[part], most[part], [self.texts[k] for k in part.tolist()]

    def cut(self, replies: list[bytes]) -> np.ndarray:
        """Which bytes go. A reply has segment numbers, first windows, counts and the least id that has these windows."""
        if not replies:
            return np.zeros(len(self.data), bool)
        number, offset, count, least = (np.concatenate(x) for x in zip(*map(unpack, replies), strict=True))
        by = np.argsort(self.segment, kind="stable")
        heads = np.searchsorted(self.segment[by], np.arange(int(self.segment.max(initial=-1)) + 2))
        times = heads[number + 1] - heads[number]
        at = np.repeat(heads[number] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
        member = by[at]
        offset, count, least = (np.repeat(x, times) for x in (offset, count, least))
        later = self.ids[self.row[member]] > least
        begin = (self.first[member] + offset)[later]
        size = len(self.data) + 1
        marks = np.bincount(begin, minlength=size) - np.bincount(begin + count[later] + self.depth - 1, minlength=size)
        return np.cumsum(marks[:-1]) > 0


def network(tied: np.ndarray, less) -> np.ndarray:
    """Sorts the rows of a matrix (a power of two columns, -1 behind the last) by bitonic steps of less(a, b)."""
    width, k = tied.shape[1], 2
    column = np.arange(width)
    while k <= width:
        j = k // 2
        while j:
            low = column[(column & j) == 0]
            up = (low & k) == 0
            a, b = tied[:, low], tied[:, low | j]
            swap = np.where(up, less(b, a), less(a, b))
            tied[:, low], tied[:, low | j] = np.where(swap, b, a), np.where(swap, a, b)
            j //= 2
        k *= 2
    return tied


class Suffixes:
    """The suffixes of some texts, those that are windows in sorted order, part by part."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.depth, self.ends = depth, np.cumsum(lengths)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.word = np.concatenate((words_at(data, ">u8"), np.zeros(depth + 16, np.uint64)))
        self.text = np.repeat(np.arange(len(texts)), lengths)
        room = self.ends[self.text] - np.arange(len(data))
        self.windows = np.flatnonzero(room >= depth)
        sample = np.flatnonzero(np.isin(np.arange(len(data)) % PERIOD, COVER))
        self.rank = np.zeros(len(data) + PERIOD, np.int64)
        self.rank[sample] = self.ranked(sample, np.minimum(room[sample], depth))

    def ranked(self, at: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Ranks of suffixes by up to `depth` bytes: a word more is looked at only where all before are equal."""
        rank = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(0, self.depth, 8):
            left = np.clip(room[open_] - k, 0, 8)
            word = np.where(left == 8, self.word[at[open_] + k], np.where(left == 0, np.uint64(0), self.word[at[open_] + k] >> ((8 - left) * 8 % 64).astype(np.uint64) << ((8 - left) * 8 % 64).astype(np.uint64)))
            order = np.lexsort((left, word, rank[open_]))
            o = open_[order]
            new = np.concatenate(([True], (rank[o][1:] != rank[o][:-1]) | (word[order][1:] != word[order][:-1]) | (left[order][1:] != left[order][:-1])))
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            base = np.flatnonzero(np.concatenate(([True], rank[o][1:] != rank[o][:-1])))
            within = np.arange(len(o)) - np.repeat(base, np.diff(np.concatenate((base, [len(o)]))))
            rank[o] = rank[o] + within[heads][group]
            sizes = np.bincount(group)
            open_ = np.sort(o[(sizes[group] > 1) & (left[order] == 8)])
            if not len(open_):
                break
        return rank

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of suffixes with equal first 16 bytes: whether a is before b, by the ranks of cover positions; -1 is behind all."""
        by = OFFSETS[a % PERIOD, b % PERIOD]
        return (a >= 0) & ((b < 0) | (self.rank[a + by] < self.rank[b + by]))

    def parts(self, most: int = 1 << 19) -> Iterator[np.ndarray]:
        """Windows by their first two bytes, about `most` at a time."""
        lead = (self.word[self.windows] >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(lead, kind="stable")
        cuts = np.flatnonzero(np.diff(lead[order])) + 1
        begin = 0
        for cut in [*cuts.tolist(), len(order)]:
            if cut - begin >= most or cut == len(order):
                yield self.windows[order[begin:cut]]
                begin = cut

    def ordered(self, at: np.ndarray) -> np.ndarray:
        """A part in suffix order."""
        at = at[np.lexsort((self.word[at + 8], self.word[at]))]
        new = np.concatenate(([True], (self.word[at[1:]] != self.word[at[:-1]]) | (self.word[at[1:] + 8] != self.word[at[:-1] + 8])))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((heads, [len(at)])))
        width = 2
        while (sizes > width // 2).any():
            chosen = (sizes > (width // 2 if width > 2 else 1)) & (sizes <= width)
            if chosen.any():
                place = heads[chosen][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[chosen][:, None]
                tied = np.where(inside, at[np.minimum(place, len(at) - 1)], -1)
                for k in range(0, len(tied), max(1, (1 << 20) // width)):
                    rows = slice(k, k + max(1, (1 << 20) // width))
                    at[place[rows][inside[rows]]] = network(tied[rows], self.less)[inside[rows]]
            width *= 2
        return at

    def least(self, ids: np.ndarray) -> np.ndarray:
        """For each window the least of the ids of all texts that have an equal one (ids: of the texts)."""
        out = np.full(len(self.text), NO_ID)
        for part in self.parts():
            at = self.ordered(part)
            same = np.ones(max(0, len(at) - 1), bool)
            for k in [*range(0, self.depth - 8, 8), self.depth - 8]:
                same &= self.word[at[1:] + k] == self.word[at[:-1] + k]
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            group = np.minimum.reduceat(ids[self.text[at]], heads)
            out[at] = np.repeat(group, np.diff(np.concatenate((heads, [len(at)]))))
        return out


def packed(docs: DataFrame, block_bytes: int, carry: list[str]) -> DataFrame:
    """Rows of whole documents in blocks: block, data, n_bytes, and pickled values of other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, k, ids, texts, others, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        done = lambda: {"block": [(part << 32) + k], "data": [pack(np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], bool), np.array(list(map(len, texts)), np.int64), b"".join(texts))], "n_bytes": [held], "others": [pack(others) if carry else None]}
        for batch in batches:
            for doc_id, text, *other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                others.append(other)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= block_bytes:
                    yield done()
                    k, ids, texts, others, held = k + 1, [], [], [], 0
        if ids:
            yield done()

    return common.arrow_map(docs.select(F.col("doc_id").cast("long"), "text", *carry), run, "block long, data binary, n_bytes long, others binary")


def whole_characters(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which bytes go if only whole characters do: those of UTF-8 characters all of whose bytes go."""
    if not gone.any():
        return gone
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.concatenate((starts, [len(data)]))))


def repeated_passages(docs: DataFrame, depth: int = 50, block_bytes: int = 1 << 21, bucket_bytes: int = 1 << 22, kept: bool = False, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, with `kept` the remaining bytes, and the columns to carry, of every document.

    characters: a character goes only if all its bytes do, so that what remains is UTF-8. Ids must be numbers.
    """
    spark = docs.sparkSession
    if clash := {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}.intersection(carry):
        raise ValueError(f"columns to carry that are named like results: {sorted(clash)}")
    blocks, path_blocks = common.written(packed(docs, block_bytes, list(carry)), "blocks")
    total = blocks.agg(F.sum("n_bytes")).head()[0] or 0
    n_buckets = int(total // bucket_bytes) + 1
    blocks, answered_blocks = blocks.select("block", "data"), blocks.select("block", "data", "others")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py(), n_buckets, depth)
                rows = [(bucket, (block.distinct[part] >> np.uint64(24)), two) for bucket, part, two in block.minimizers()]
                blobs = [((h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (h >> np.uint64(32)).astype(np.uint8).tobytes() + np.packbits(two).tobytes()) for _, h, two in rows]
                yield {"bucket": [r[0] for r in rows], "block": [number] * len(rows), "n": [len(r[1]) for r in rows], "data": blobs}

    def shared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ns, blobs = rows.column("n").to_pylist(), rows.column("data").to_pylist()
        h = [np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32) for b, n in zip(blobs, ns, strict=True)]
        two = [np.unpackbits(np.frombuffer(b, np.uint8, offset=5 * n), count=n).astype(bool) for b, n in zip(blobs, ns, strict=True)]
        _, which, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        flags = (times > 1)[which]
        masks, at = [], 0
        for n, own in zip(ns, two, strict=True):
            mask = flags[at : at + n] | own
            masks.append(np.packbits(mask).tobytes() if mask.any() else None)
            at += n
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "mask": pa.array(masks, pa.binary())}).filter(pa.array([m is not None for m in masks]))

    counts = common.arrow_map(blocks, count, "bucket int, block long, n int, data binary")
    masks = counts.groupBy("bucket").applyInArrow(shared, "block long, bucket int, mask binary")
    masks, path_masks = common.written(masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks")), "masks")
    flagged = blocks.join(masks.hint("shuffle_hash"), "block", "left")

    def opened(batch: pa.RecordBatch, k: int) -> Block:
        block = Block(batch.column("data")[k].as_py(), n_buckets, depth)
        block.flag([(m["bucket"], m["mask"]) for m in batch.column("masks")[k].as_py() or []])
        return block

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list((block := opened(batch, k)).segments())
                blobs = [pack(numbers, least, most, np.array(list(map(len, texts)), np.int32), b"".join(texts)) for _, numbers, least, most, texts in rows]
                yield {"bucket": [*(r[0] for r in rows), -1], "block": [batch.column("block")[k].as_py()] * (len(rows) + 1), "data": [*blobs, pack(block.first, block.row, block.segment)]}

    def sort(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        ids, asked = [], []
        for blob in rows.column("data"):
            numbers, least, most, lengths, raw = unpack(blob.as_py())
            ends = np.cumsum(lengths).tolist()
            which = np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
            asked.append((numbers, most, which))
            ids.append((which, least))
        own = np.full(len(index), NO_ID)
        for which, least in ids:
            np.minimum.at(own, which, least)
        suffixes = Suffixes(list(index), depth)
        least = suffixes.least(own)
        # Runs of windows with the same least id, by text.
        at = suffixes.windows
        new = np.concatenate(([True], (np.diff(at) != 1) | (suffixes.text[at[1:]] != suffixes.text[at[:-1]]) | (least[at[1:]] != least[at[:-1]]))) if len(at) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        run_text, run_size, run_least = suffixes.text[at[head]], np.diff(np.concatenate((head, [len(at)]))), least[at[head]]
        run_offset = at[head] - (np.concatenate(([0], suffixes.ends[:-1])))[run_text] if len(head) else at[head]
        begin = np.searchsorted(run_text, np.arange(len(index) + 1))
        replies = []
        for numbers, most, which in asked:
            times = begin[which + 1] - begin[which]
            run = np.repeat(begin[which] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
            useful = run_least[run] < np.repeat(most, times)
            run = run[useful]
            replies.append(pack(np.repeat(numbers, times)[useful], run_offset[run], run_size[run], run_least[run]) if len(run) else None)
        return pa.table({"block": rows.column("block"), "reply": pa.array(replies, pa.binary())}).filter(pa.array([r is not None for r in replies]))

    # Bucket -1 is where the segments are in their block.
    sent, path_sent = common.written(common.arrow_map(flagged, send, "bucket int, block long, data binary"), "segments")
    common.remove(spark, path_masks)
    places = sent.filter("bucket < 0").select("block", F.col("data").alias("places"))
    replies = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(sort, "block long, reply binary")
    replies, path_replies = common.written(replies.groupBy("block").agg(F.collect_list("reply").alias("replies")), "replies")
    answered = answered_blocks.join(places.hint("shuffle_hash"), "block", "left").join(replies.hint("shuffle_hash"), "block", "left")
    extra = ({"kept": "binary"} if kept else {}) | {c: dict(docs.dtypes)[c] for c in carry}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.column("data")[k].as_py(), n_buckets, depth, unpack(batch.column("places")[k].as_py()))
                gone = block.cut(batch.column("replies")[k].as_py() or [])
                gone = whole_characters(gone, block.data) if characters else gone
                edge = gone & np.concatenate(([True], ~gone[:-1])) if len(gone) else gone
                edge[block.starts[block.starts < len(gone)]] |= gone[block.starts[block.starts < len(gone)]]
                before, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(edge)))
                rest = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
                yield {
                    "doc_id": [i if known else None for i, known in zip(block.ids.tolist(), block.known.tolist(), strict=True)],
                    "n_bytes": block.ends - block.starts,
                    "n_removed": before[block.ends] - before[block.starts],
                    "n_spans": spans[block.ends] - spans[block.starts],
                    "kept_sha256": [hashlib.sha256(x).hexdigest() for x in rest],
                } | ({"kept": rest} if kept else {}) | (dict(zip(carry, map(list, zip(*unpack(batch.column("others")[k].as_py())[0], strict=True)), strict=True)) if carry else {})

    return common.arrow_map(answered, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {n} {t}" for n, t in extra.items()))


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))
