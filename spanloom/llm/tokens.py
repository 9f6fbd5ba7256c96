"""Token counts by offset-mapped attribution.

A whole document is encoded once by a byte-level BPE. The tokens' byte lengths give their byte offsets, which map
to character spans (a token that begins inside a character starts at that character). The sections of a document
are consecutive character intervals; both interval lists are sorted, so the interval join is a binary search of
token bounds among section bounds. A token that crosses a section's end goes to one section by an explicit rule:

* "start": the section that holds its first character (default)
* "end": the section that holds its last character
* "majority": the section with most of its characters, the earlier one on a tie

Defined cases: null and empty texts have no tokens and no sections; repeated rows are counted each on its own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pre-splitting pattern of the public 50k byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SECTIONS = {"lines": r"[^\n]*\n|[^\n]+", "paragraphs": r"(?s).+?(?:\n{2,}|\Z)", "sentences": r"[^.!?\n]*(?:[.!?]+|\n|\Z)"}


def encoder(path: str):
    """The tokenizer, and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("spans", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, from the byte lengths of the tokens in order."""
    ends = np.cumsum(lengths)
    of_byte = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
    return of_byte[ends - lengths], of_byte[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """For each token the index of its section and whether it crosses a section's end; starts: where the sections begin."""
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    if rule == "start":
        return a, a != b
    if rule == "end":
        return b, a != b
    if rule != "majority":
        raise ValueError(f"no such rule: {rule}")
    best = a.copy()
    for i in np.flatnonzero(a != b):
        cuts = np.concatenate(([first[i]], starts[a[i] + 1 : b[i] + 1], [last[i] + 1]))
        best[i] = a[i] + int(np.argmax(np.diff(cuts)))
    return best, a != b


def attribute(docs: DataFrame, vocabulary: str = VOCABULARY, sections: str = "lines", rule: str = "start") -> DataFrame:
    """Per document: n_tokens, n_sections, n_crossing, section_tokens (a count for each section, summing to n_tokens)."""
    pattern = SECTIONS.get(sections, sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoding, sizes = encoder(vocabulary)
        cut = re.compile(pattern)
        for batch in batches:
            out: dict = {"doc_id": batch.column(0), "n_tokens": [], "n_sections": [], "n_crossing": [], "section_tokens": []}
            for text in batch.column(1).to_pylist():
                text = text or ""
                ids = np.asarray(encoding.encode_ordinary(text), np.int64)
                starts = np.array([m.start() for m in cut.finditer(text) if m.end() > m.start()] or ([0] if text else []), np.int64)
                if len(starts):
                    starts[0] = 0
                    at, crosses = allocate(*token_spans(text.encode(), sizes[ids]), starts, rule)
                    counts, crossing = np.bincount(at, minlength=len(starts)), int(crosses.sum())
                else:
                    counts, crossing = np.zeros(0, np.int64), 0
                for name, value in (("n_tokens", len(ids)), ("n_sections", len(starts)), ("n_crossing", crossing), ("section_tokens", counts)):
                    out[name].append(value)
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    return common.arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    return attribute(common.table(spark, sf_dir, "documents"), sections="sentences")
