"""Near-duplicate detection by SimHash and Golay-code fuzzy hashing.

A fingerprint has a bit for each of 64: set if over half of the shingles' hashes have it. Fingerprints are cut
into three segments (22, 21, 21 bits), each padded to a word of the perfect binary Golay code [23, 12, 7]. Every
word lies within three bits of exactly one codeword. Let x and y be words one bit apart: the codeword next to x is
within four bits of y. So a segment's keys are the indices of all codewords within four bits of it: the nearest,
and if that is three bits away also the five at distance four.

Of three or fewer errors over three segments two segments have at most one each. The keys of each pair of segments
are the pairs of codeword indices; two fingerprints within three bits share one of them. Tables of very many
fingerprints get wider keys in the same way, of one whole quarter and two others' indices. Distinct fingerprints are
dealt by these keys, and in each bucket a search that takes one fingerprint at a time against those not reached
yet links all that are within three bits of another: at most one link for each fingerprint instead of all pairs,
with the same components. Every link is verified on the whole fingerprint.

Resemblance of shingle sets (similar_documents) is decided on the sets. Sets with fingerprints within three bits are
found as above and verified; since sets that resemble each other by 0.8 mostly differ in more bits, an exact prefix
filter finds the others. The shingles of each set are ordered by the number of sets that hold them, rare ones first.
Two sets of n shingles and more that resemble each other by t share ceil(t n) of them at least, so that they share
one among the first n - ceil(t n) + 1 of each. Shingles that no other set holds come first and are never dealt; sets
meet under each other one of that prefix. Where they meet, the sizes, the places of the shingle and the parities of
1024 classes of shingles bound how alike they can be, which leaves out pairs only that cannot be alike. One set of
each bucket is verified against the others first; of the rest all pairs that are not connected yet by verified links
are verified. So every pair of that resemblance is connected, and nothing is joined without a check on the sets.

Defined cases: null texts and texts without words have fingerprint zero, which links like any other; null ids
join no component id but their group's least id (null if all are null); repeated rows are rows of their own; an
empty table gives an empty result; other columns are ignored. similar_documents leaves out rows without an id; rows
that repeat an id are rows of their own, told apart by a hash of their text; documents with equal shingle sets (a
hash of the sorted set, 64 bits) are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common
from spanloom.llm.components import components

SEED = 42
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0b110001110101
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints from which on keys are wide: buckets of the short ones would hold some 30 by chance.
WIDE_FROM = 20_000_000
#: Bits of the parities of a shingle set.
PARITY_BITS = 1024


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for k in range(22, 10, -1):
        rest = np.where((rest >> k) & 1, rest ^ (GENERATOR << (k - 11)), rest)
    return rest


def patterns() -> list[np.ndarray]:
    """For each of the 2048 syndromes the error patterns of up to four bits that have it, the lightest first."""
    bits, found = [1 << k for k in range(23)], [[] for _ in range(2048)]
    layer = [(0, 0)]
    for weight in range(5):
        masks = np.array([m for m, _ in layer], np.int64)
        for mask, s in zip(masks.tolist(), syndromes(masks).tolist(), strict=True):
            if not found[s] or weight == 4 and found[s][0].bit_count() == 3:
                found[s].append(mask)
        layer = [(m | bits[k], k + 1) for m, low in layer for k in range(low, 23)]
    return [np.array(x, np.int64) for x in found]


class Golay:
    """Keys of segments, as a table of six codeword indices for each syndrome's patterns (-1: none)."""

    def __init__(self) -> None:
        self.table = np.full((2048, 6), -1, np.int64)
        for s, x in enumerate(patterns()):
            self.table[s, : len(x)] = x

    def keys(self, segment: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords within four bits of each segment: 12 message bits, -1 where there are fewer."""
        errors = self.table[syndromes(segment)]
        return np.where(errors < 0, -1, (segment.astype(np.int64)[:, None] ^ errors) >> 11)

    def bucket_keys(self, prints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys: of all pairs of three segments, or (wide) of one whole quarter and two others."""
        return self._quarters(prints) if wide else self._pairs(prints)

    def _both(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and pairs of indices, 24 bits."""
        ok = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
        return np.nonzero(ok)[0], ((a[:, :, None] << 12) | b[:, None, :])[ok]

    def _pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [self.keys(((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)) for low, width in SEGMENTS]
        rows, out = [], []
        for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            row, key = self._both(each[a], each[b])
            rows.append(row)
            out.append(key | (pair << 24))
        return np.concatenate(rows), np.concatenate(out)

    def _quarters(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three errors over four quarters leave one without any and two more with at most one each."""
        quarters = [((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
        each, rows, out = [self.keys(q) for q in quarters], [], []
        for kind, (whole, a, b) in enumerate((w, x, y) for w in range(4) for x in range(4) for y in range(x + 1, 4) if w not in (x, y)):
            row, key = self._both(each[a], each[b])
            rows.append(row)
            out.append(key | quarters[whole][row] << 24 | kind << 40)
        return np.concatenate(rows), np.concatenate(out)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text, its words lower-cased in A-Z; repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [words] if len(words) < width else zip(*[words[k:] for k in range(width)], strict=False)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in map(b" ".join, shingles)], np.uint64)


def majority(hashes: np.ndarray, block: int = 65_536) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), block):
        part = hashes[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    return majority(shingle_hashes(text, width))


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield {"doc_id": batch.column(0), "print": pa.array(values.view(np.int64))}

    return common.arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, print long")


def bucket_links(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all prints of one bucket that are connected within `bits`: a forest, not all pairs."""
    left, a, b = prints.copy(), [], []
    while len(left):
        reached = left[:1]
        left = left[1:]
        while len(reached) and len(left):
            node, reached = reached[0], reached[1:]
            near = np.bitwise_count(left ^ node) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), node))
                b.append(found)
                reached, left = np.concatenate((reached, found)), left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def buckets_with_links(keys: np.ndarray, prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int, most: int = 64) -> np.ndarray:
    """Numbers of the buckets to search: those of over `most` prints, and those in which some pair is within `bits`."""
    bucket = np.repeat(np.arange(len(starts)), sizes)
    found = sizes > most
    at, off = np.flatnonzero(~found[bucket]), 1
    while len(at := at[at + off < len(keys)]) and len(at := at[keys[at] == keys[at + off]]):
        found[bucket[at[np.bitwise_count(prints[at] ^ prints[at + off]) <= bits]]] = True
        off += 1
    return np.flatnonzero(found)


def links_of(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted buckets; most buckets by chance have none."""
    a, b = [prints[:0]], [prints[:0]]
    if len(keys):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        for k in buckets_with_links(keys, prints, starts, sizes, bits):
            x, y = bucket_links(prints[starts[k] : starts[k] + sizes[k]], bits)
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def dealt_links(keyed: DataFrame, bits: int) -> DataFrame:
    """(u, v) of prints that meet under a key and are linked in its bucket's forest. keyed: key, print."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(keys: np.ndarray, prints: np.ndarray) -> dict:
            a, b = links_of(keys, prints, bits)
            return {"u": pa.array(a.view(np.int64)), "v": pa.array(b.view(np.int64))}

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(keys) and len(cut := np.flatnonzero(keys != keys[-1])):  # the last bucket may go on
                n = cut[-1] + 1
                yield done(keys[:n], prints[:n])
                keys, prints = keys[n:], prints[n:]
        yield done(keys, prints)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "print")
    return common.arrow_map(dealt, meet, "u long, v long", 1 << 16).distinct()


def links(distinct: DataFrame, bits: int = 3, wide: bool | None = None) -> DataFrame:
    """(u, v) of distinct fingerprints (column print): a forest in each bucket, whose union connects all within `bits`.

    Both kinds of keys are complete. The short ones are about 85 of 25 bits a fingerprint; a table of over WIDE_FROM
    fingerprints gets the wide ones, about 340 of 44 bits, so that its buckets stay small.
    """
    wide = distinct.count() > WIDE_FROM if wide is None else wide

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        golay = Golay()
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(prints), 1024):
                rows, keys = golay.bucket_keys(prints[k : k + 1024], wide)
                yield {"key": pa.array(keys.astype(np.int64 if wide else np.int32)), "print": pa.array(prints[k : k + 1024][rows].view(np.int64))}

    return dealt_links(common.arrow_map(distinct.select("print"), emit, f"key {'long' if wide else 'int'}, print long"), bits)


def with_components(rows: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """Adds to rows (column print) the least doc_id of all documents reachable. classes: print, least; linked: u, v."""
    found = components(linked)
    grouped = classes.join(found, classes["print"] == found["node"], "left").withColumn("root", F.coalesce("component", "print"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(named, "print")


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """doc_id, print, component_id (the least doc_id of all documents reachable over links)."""
    if bits > 3:
        raise ValueError("the keys are complete up to three bits")
    rows, _ = common.written(with_fingerprints(docs, width), "prints")
    classes, _ = common.written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    return with_components(rows, classes, links(classes.select("print"), bits))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Adds `shingles`, the distinct hashes of a text's shingles, to rows with a text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = docs.withColumn("_words", common.words_of(F.translate("text", upper, upper.lower())))
    whole = F.array(F.xxhash64(F.array_join("_words", " ")))
    return df.withColumn("shingles", F.array_distinct(F.coalesce(common.windows_of("_words", width), whole))).drop("_words")


def column(values: pa.Array) -> np.ndarray:
    """An Arrow column as an array; binary values of one length as rows of 64-bit words."""
    if pa.types.is_binary(values.type):
        return np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(len(values), -1)
    return values.to_numpy(zero_copy_only=False)


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches again, cut so that the rows of a key (the first column) stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [column(batch.column(k)) for k in range(batch.num_columns)]
        cut = len(now[0]) if now[0][0] == now[0][-1] else int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
        if held and (now[0][0] != held[-1][0][-1] or cut < len(now[0])):  # the last bucket is whole
            head = cut if cut < len(now[0]) else 0
            yield [np.concatenate(x) for x in zip(*held, [c[:head] for c in now], strict=True)]
            held, now = [], [c[head:] for c in now]
        elif cut < len(now[0]):
            yield [c[:cut] for c in now]
            now = [c[cut:] for c in now]
        held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shared_shingles(keyed: DataFrame) -> DataFrame:
    """key, print, sets: of rows (key, print), repeated ones once, those whose key is in two sets or more, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for keys, prints in buckets_of(batches):
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])))
            keys, prints = keys[fresh], prints[fresh]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            many = (each := np.repeat(sizes, sizes)) > 1
            yield {"key": pa.array(keys[many]), "print": pa.array(prints[many]), "sets": pa.array(each[many].astype(np.int64))}

    return common.arrow_map(keyed.repartition("key").sortWithinPartitions("key", "print"), run, "key long, print long, sets long", 1 << 16)


def parities(keys: np.ndarray) -> bytes:
    """A bit for each of PARITY_BITS classes of keys: whether an odd number of them is there.

    Two sets whose bits differ in d places differ in d elements or more.
    """
    return np.packbits(np.bincount((keys.view(np.uint64) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def with_sketches(lists: DataFrame) -> DataFrame:
    """Adds to print, n, shared (structs of sets, key, the rarest first) the fingerprint of the shared shingles and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at, keys = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            own = [keys[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            prints = np.array([majority(k.view(np.uint64)) for k in own], np.uint64)
            yield {"print": batch.column(0), "n": batch.column(1), "keys": batch.column(2), "sets": batch.column(3), "simhash": pa.array(prints.view(np.int64)), "parities": list(map(parities, own))}

    flat = lists.select("print", "n", F.col("shared.key").alias("keys"), F.col("shared.sets").alias("sets"))
    return common.arrow_map(flat, run, "print long, n long, keys array<long>, sets array<long>, simhash long, parities binary")


def dealt_prefixes(sets: DataFrame, least: float, most: int) -> DataFrame:
    """key, part, print, n, own, place, parities: each set under each shared shingle of its prefix.

    A shingle of more than `most` sets deals its sets to groups, and each two groups meet under a `part` of their own.
    """
    own = F.col("n") - F.size("keys")
    prefix = F.greatest(F.lit(0).cast("long"), F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - own).cast("int")
    rows = sets.select("print", "n", own.alias("own"), "parities", F.posexplode(F.slice(F.arrays_zip("keys", "sets"), F.lit(1), prefix)).alias("at", "x"))
    groups = F.ceil(F.col("x.sets") / most).cast("int")
    group = F.pmod(F.xxhash64("print"), groups).cast("int")
    parts = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.least(group, g) * groups + F.greatest(group, g))
    rows = rows.withColumn("parts", F.when(F.col("x.sets") > most, parts).otherwise(F.array(F.lit(0))))
    return rows.select(F.col("x.keys").alias("key"), F.explode("parts").alias("part"), "print", "n", "own", (F.col("own") + F.col("at")).alias("place"), "parities")


def bucket_pairs(dealt: DataFrame, least: float, first: bool) -> DataFrame:
    """(u, v) of sets that meet under a key, may be alike and are in different components. dealt: also component.

    `first` compares one set of each bucket, another one under each key, with the others. Else all pairs are compared
    but those inside the bucket's largest component.
    """

    def may(one: int, others: np.ndarray, n: np.ndarray, own: np.ndarray, place: np.ndarray, bits: np.ndarray, component: np.ndarray) -> np.ndarray:
        """Those of others whose sizes, the places of the key and the parities allow the resemblance."""
        others = others[component[others] != component[one]]
        both = n[others] + n[one]
        ok = np.minimum(n[others], n[one]) >= least * np.maximum(n[others], n[one]) - 1e-9
        ok &= np.minimum(n[others] - place[others], n[one] - place[one]) >= least / (1 + least) * both - 1e-9
        others, both = others[ok], both[ok]
        differ = np.bitwise_count(bits[others] ^ bits[one]).sum(axis=1, dtype=np.int64) + own[others] + own[one]
        return others[differ <= (1 - least) / (1 + least) * both + 1e-9]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b, waiting = [], [], 0
        for keys, part, prints, n, own, place, component, bits in buckets_of(batches):
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))))
            ends = np.concatenate((starts[1:], [len(keys)]))
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                if (component[lo:hi] == component[lo]).all():
                    continue
                rows = np.arange(lo, hi)
                if first:
                    tried = [(lo + int(keys[lo]) % (hi - lo), rows)]
                else:
                    names, which, times = np.unique(component[lo:hi], return_inverse=True, return_counts=True)
                    main = which == times.argmax()
                    loose = rows[~main]
                    tried = ((i, np.concatenate((rows[main], loose[k + 1 :]))) for k, i in enumerate(loose.tolist()))
                for i, others in tried:
                    found = prints[may(i, others, n, own, place, bits, component)]
                    if len(found):
                        a.append(np.minimum(found, prints[i]))
                        b.append(np.maximum(found, prints[i]))
                        waiting += len(found)
                    if waiting > 1 << 16:
                        yield {"u": pa.array(np.concatenate(a)), "v": pa.array(np.concatenate(b))}
                        a, b, waiting = [], [], 0
        if a:
            yield {"u": pa.array(np.concatenate(a)), "v": pa.array(np.concatenate(b))}

    ordered = dealt.select("key", "part", "print", "n", "own", "place", "component", "parities").repartition("key", "part").sortWithinPartitions("key", "part", "print")
    return common.arrow_map(ordered, run, "u long, v long", 1 << 14).distinct()


def similar_documents(docs: DataFrame, least: float = 0.8, width: int = 5, most: int = 4096) -> DataFrame:
    """doc_id, text_hash, print (the hash of the shingle set), component_id over links between shingle sets whose resemblance is `least` or more, stays (whether the row is its component's least by id and text_hash)."""
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    whole = shingle_sets(texts, width).select("doc_id", F.xxhash64("text").alias("text_hash"), F.sort_array("shingles").alias("shingles")).withColumn("print", F.xxhash64("shingles"))
    rows, _ = common.written(whole.select("doc_id", "text_hash", "print", F.size("shingles").cast("long").alias("n")), "prints")
    classes, _ = common.written(rows.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n").alias("n")), "classes")
    shared = shared_shingles(whole.select(F.explode("shingles").alias("key"), "print"))
    lists = shared.groupBy("print").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("shared"))
    sets, path_sets = common.written(with_sketches(lists.join(classes.select("print", "n"), "print").filter(F.size("shared") >= F.ceil(least * F.col("n") - 1e-9))), "sets")
    dealt, path_dealt = common.written(dealt_prefixes(sets, least, most), "dealt")

    def alike(pairs: DataFrame) -> DataFrame:
        b = pairs.join(sets.select(F.col("print").alias("v"), F.col("n").alias("_m"), F.col("keys").alias("_b")), "v")
        both = b.join(sets.select(F.col("print").alias("u"), F.col("n").alias("_n"), F.col("keys").alias("_a")), "u")
        common_ones = F.size(F.array_intersect("_a", "_b"))
        return both.filter(common_ones >= least * (F.col("_n") + F.col("_m") - common_ones)).select("u", "v")

    # Sets with near fingerprints and one set of each bucket first; of the other pairs only those between what is not connected yet can change a component.
    held, path_held = common.written(sets.select("print", "simhash"), "simhashes")
    near = links(held.select(F.col("simhash").alias("print")).distinct())
    member = held.groupBy("simhash").agg(F.min("print").alias("print"))
    same = held.join(member.withColumnRenamed("print", "first"), "simhash").filter("print <> first").select(F.least("print", "first").alias("u"), F.greatest("print", "first").alias("v"))
    ends = near.join(member.select(F.col("simhash").alias("u"), F.col("print").alias("a")), "u").join(member.select(F.col("simhash").alias("v"), F.col("print").alias("b")), "v")
    golay = same.union(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    linked, _ = common.written(alike(golay.union(bucket_pairs(dealt.withColumn("component", F.col("print")), least, True)).distinct()), "first_links")
    known = components(linked)
    now = dealt.join(known, dealt["print"] == known["node"], "left").withColumn("component", F.coalesce("component", "print"))
    rest, _ = common.written(alike(bucket_pairs(now, least, False)), "other_links")
    for path in (path_held, path_dealt, path_sets):
        common.remove(docs.sparkSession, path)
    found = with_components(rows.select("doc_id", "text_hash", "print"), classes.select("print", "least"), linked.union(rest))
    stays = F.struct("doc_id", "text_hash") == F.col("component_id")
    return found.select("doc_id", "text_hash", "print", F.col("component_id.doc_id").alias("component_id"), stays.alias("stays"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    df = near_duplicates(common.table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
