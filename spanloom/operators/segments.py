"""Spans, tokens and phrases of whole batches of texts at once, by arrays of bytes: text.spans() and text.tokens() without an expression for each row."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanloom.functions import text

#: Elements are dealt to 2 ** BITS buckets by a hash that a phrase's can be made from those of its tokens.
BITS, BASE = 20, np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_VOWEL = np.isin(_BYTES, list(b"aeiouAEIOU"))
_BLANK = np.isin(_BYTES, list(b"\t\n\v\f\r "))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each string ends in them; nulls are empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The strings that lie in some bytes one after another."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(data.tobytes())])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _other_letters(data: np.ndarray) -> np.ndarray:
    """Where letters beyond ASCII begin."""
    lead = np.flatnonzero(data >= 0xC0)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    b0, b1, b2, b3 = (padded[lead + k] & (0xFF if k == 0 else 0x3F) for k in range(4))
    point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return lead[_letters()[np.minimum(point, sys.maxunicode)]]


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and of each informative line its text's row, where it begins and where it ends."""
    data, ends = _bytes(texts)
    n = len(data)
    if not n:
        return data, *(np.zeros(0, np.int64) for _ in range(3))
    blank = _BLANK[data]
    wide = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], (0x85, 0xA0)))
    blank[wide] = blank[wide + 1] = True
    # Lines end at line breaks and at the ends of texts.
    stops = np.unique(np.concatenate((np.flatnonzero(data == 10), ends[ends > 0])))
    first, last = _runs(~blank)
    begins = np.concatenate(([0], stops[:-1]))
    cut_ = stops[(stops > 0) & (stops < n)]
    cut_ = cut_[~blank[cut_] & ~blank[cut_ - 1]]
    first, last = np.sort(np.concatenate((first, cut_))), np.sort(np.concatenate((last, cut_)))
    # A line goes from its first run of other than blanks to its last.
    a, b = np.searchsorted(first, begins), np.searchsorted(last, stops, "right")
    some = a < b
    begin, end = first[a[some]], last[b[some] - 1]
    gap = (data == 32) | (data == 9)
    counted = (data & 0xC0) != 0x80
    counted[1:] &= ~(gap[1:] & gap[:-1])
    letter = _LETTER[data]
    letter[_other_letters(data)] = True
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    size, letters = (x[end] - x[begin] for x in (upto(counted), upto(letter)))
    keep = np.where(size < 20, letters >= 10, letters / np.maximum(size, 1) >= 0.3)
    begin, end = begin[keep], end[keep]
    return data, np.searchsorted(ends, begin, "right"), begin, end


def positions(row: np.ndarray) -> np.ndarray:
    """The place of each line among those of its text."""
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The normal tokens of each line, with a blank after each."""
    line = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(len(line)) + np.repeat(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin)
    hyphen = data[at] == 45
    at, line = at[~hyphen], line[~hyphen]
    chars = data[at]
    letter = _LETTER[chars]
    first, last = _runs(letter)
    # A run that goes over the end of a line is two.
    over = np.flatnonzero((line[1:] != line[:-1]) & letter[1:] & letter[:-1]) + 1
    first, last = np.sort(np.concatenate((first, over))), np.sort(np.concatenate((last, over)))
    low = np.concatenate((chars | 32, np.zeros(8, np.uint8)))
    vowels = np.concatenate(([0], np.cumsum(_VOWEL[chars])))
    keep = (last - first >= 3) & (vowels[last] > vowels[first])
    first, last = first[keep], last[keep]
    structural = np.zeros(len(first), bool)
    for prefix in text.STRUCTURAL:
        same = last - first >= len(prefix)
        for k, c in enumerate(prefix.encode()):
            same &= low[first + k] == c
        structural |= same
    first, last = first[~structural], last[~structural]
    length = last - first + 1
    place = np.arange(int(length.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(first) else np.zeros(0, np.int64)
    out = low[place]
    out[np.cumsum(length) - 1] = 32
    return _strings(out, np.bincount(line[first], weights=length, minlength=len(begin)).astype(np.int64) if len(first) else np.zeros(len(begin), np.int64))


def lines(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The text of each line, runs of blanks and tabs as one blank."""
    line = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(len(line)) + np.repeat(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin)
    chars = data[at]
    chars[chars == 9] = 32
    gap = chars == 32
    # A line begins with another character.
    keep = ~gap | np.concatenate(([True], ~gap[:-1])) if len(gap) else gap
    return _strings(chars[keep], np.bincount(line[keep], minlength=len(begin)))


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens, the row of each, and whether the next one follows it in its span.

    A row is a string in which a blank is behind each token and a line break behind each span but the last, or a list
    of tokens in which spans are parted by a null.
    """
    if not pa.types.is_list(column.type):
        data, ends = _bytes(column)
        blank = np.flatnonzero(data == 32)
        broken = np.flatnonzero(data == 10)
        row = np.searchsorted(ends, blank, "right")
        mark = np.searchsorted(broken, blank)
        begin = np.concatenate(([0], blank[:-1] + 1)) if len(blank) else blank
        # Line breaks stand before a token.
        behind = np.concatenate(([0], mark[:-1])) if len(mark) else mark
        tokens = _strings(data[(data != 32) & (data != 10)], blank - begin - (mark - behind))
        return tokens, row, np.append((row[1:] == row[:-1]) & (mark[1:] == mark[:-1]), False) if len(row) else np.zeros(0, bool)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, tokens = np.repeat(np.arange(len(column)), lengths), column.flatten()
    known = np.flatnonzero(tokens.is_valid().to_numpy(zero_copy_only=False))
    row = row[known]
    follows = np.append((row[1:] == row[:-1]) & (np.diff(known) == 1), False) if len(row) else np.zeros(0, bool)
    return tokens.take(pa.array(known)), row, follows


def hashes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each string s the sum of s[k] * BASE ** k, and BASE to the power of its length, modulo 2 ** 64."""
    data, ends = _bytes(names)
    lengths = np.diff(np.concatenate(([0], ends)))
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(int(lengths.max(initial=0)), BASE, np.uint64))))
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers[place], dtype=np.uint64)))
    return upto[ends] - upto[ends - lengths], powers[lengths]


def bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64)


class Elements:
    """The elements of some rows: their tokens, and phrases of two tokens in a row of a span."""

    def __init__(self, column: pa.Array) -> None:
        tokens, self.row, follows = split(column)
        known = tokens.dictionary_encode()
        self.names, self.codes, self.at = known.dictionary.cast(pa.string()), known.indices.to_numpy().astype(np.int64), np.flatnonzero(follows)
        h, power = hashes(self.names)
        first, second = self.codes[self.at], self.codes[self.at + 1]
        #: The bucket of each token, and that of each phrase.
        self.single = bucket(h)[self.codes]
        self.pair = bucket(h[first] + power[first] * (np.uint64(32) + BASE * h[second]))

    def coded(self, wanted: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct elements, and the element and row of each occurrence; `wanted` says of which buckets."""
        one = np.arange(len(self.codes)) if wanted is None else np.flatnonzero(wanted[self.single])
        at = self.at if wanted is None else self.at[wanted[self.pair]]
        size = max(1, len(self.names))
        singles, codes = np.unique(self.codes[one], return_inverse=True)
        pairs, which = np.unique(self.codes[at] * size + self.codes[at + 1], return_inverse=True)
        a, b = np.divmod(pairs, size)
        phrases = pc.binary_join_element_wise(self.names.take(pa.array(a)), self.names.take(pa.array(b)), " ")
        # Where a tokenizer leaves blanks inside of tokens a phrase may be a token too.
        every = pa.chunked_array([self.names.take(pa.array(singles)), phrases]).combine_chunks().dictionary_encode()
        to = every.indices.to_numpy().astype(np.int64)
        return every.dictionary, np.concatenate((to[codes], to[len(singles) + which])), np.concatenate((self.row[one], self.row[at]))


def counts(names: pa.Array, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each element occurs, and in how many rows."""
    size = max(1, len(names))
    return np.bincount(codes, minlength=len(names)), np.bincount(np.unique(row * size + codes) % size, minlength=len(names))


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of a column of strings."""
    ends, begin = _bytes(batch.column(column))[1], 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def together(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
