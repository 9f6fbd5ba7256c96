"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's features are counts over its characters and words (see `line_features`) together with those of the lines
before and behind it. The field is fitted by gradient ascent on documents whose lines all bear the document's
label; features for fitting are made on the executors, and only those of a bounded sample of labelled documents
(`max_train`, chosen by hash, and `max_lines` of each) come to the driver. Forward-backward marginals of "good",
weighted with the lines' lengths, make the score of a document. Labels, language, source and id are no inputs of a
score. A long text is seen in parts, and four numbers a line stay of it.

Defined cases: null texts are empty; an empty text is one empty line; repeated rows are scored each on its own;
an empty table gives an empty result; without labels every score is the prior's 0.5; a null id is not held out; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanloom.llm import common

THRESHOLD = 0.7
# Bits of a character's class.
SPACE, LETTER, UPPER, DIGIT, SYMBOL, BANG, STOP, OTHER = (1 << k for k in range(8))
N_BASE = 19


def class_table() -> np.ndarray:
    """The class bits of each code point below 65536."""
    table = np.zeros(65_536, np.uint8)
    for code in range(65_536):
        c = chr(code)
        table[code] = SPACE if c.isspace() else LETTER | (UPPER if c.isupper() else 0) if c.isalpha() else DIGIT if c.isdigit() else SYMBOL if c in "#*$%&|<>" else BANG if c == "!" else STOP if c in ".,;:?" else OTHER
    return table


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.float64)


def line_features(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and how many lines each text has.

    All texts are seen as one array of code points, so that no Python code runs for a single character or word.
    """
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    kinds = table[np.minimum(codes, 65_535)]
    count = {bit: sums((kinds & bit) != 0, starts) for bit in (SPACE, LETTER, UPPER, DIGIT, SYMBOL, BANG, STOP)}
    space = (kinds & SPACE) != 0
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    words = np.zeros(len(starts))
    repeated, short, single = np.zeros_like(words), np.zeros_like(words), np.zeros_like(words)
    if len(begins):
        stops = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        place = np.arange(len(codes)) - np.repeat(np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(codes)]))))
        powers = np.full(int((stops - begins).max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        mixed = np.where(space, np.uint64(0), codes.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)]
        hashes = np.add.reduceat(mixed, begins)
        line = np.searchsorted(ends, begins)
        words = np.bincount(line, minlength=len(starts)).astype(np.float64)
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])))
        repeated = np.bincount(line, same, len(starts))
        length = stops - begins
        short = np.bincount(line, length <= 3, len(starts))
        single = np.bincount(line, length >= 9, len(starts))
    n, w, letters = np.maximum(size, 1), np.maximum(words, 1), np.maximum(count[LETTER], 1)
    rate = {"symbol": count[SYMBOL] / w, "bang": count[BANG] / w, "upper": count[UPPER] / letters, "repeated": repeated / w, "short": short / w}
    columns = [
        np.log1p(size) / 5, count[LETTER] / n, rate["upper"], count[DIGIT] / n, np.minimum(rate["symbol"], 4), np.minimum(rate["bang"], 4), np.minimum(count[STOP] / w, 2),
        np.minimum((size - count[SPACE]) / w, 30) / 10, rate["short"], rate["repeated"], single / w,
        rate["symbol"] > 0.2, rate["bang"] > 0.2, rate["upper"] > 0.4, rate["repeated"] > 0.2, (rate["short"] < 0.1) & (words > 4), words <= 2, size == 0, np.ones(len(size)),
    ]
    return np.stack(columns, axis=1).astype(np.float64), size, n_lines


def parts_of(text: str, limit: int = 1 << 19) -> Iterator[str]:
    """A text in parts of about `limit` characters, cut behind a line."""
    start = 0
    while start >= 0:
        end = text.find("\n", start + limit)
        yield text[start:] if end < 0 else text[start:end]
        start = end + 1 if end >= 0 else -1


def long_features(text: str, table: np.ndarray, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of one text, made part by part."""
    own, size, n_lines = zip(*(line_features([part], table) for part in parts_of(text, limit)), strict=True)
    return np.concatenate(own), np.concatenate(size), np.sum(n_lines, axis=0)


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and behind it in its document (0 where there is none)."""
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    before, behind = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.concatenate((own, before, behind), axis=1)


@dataclass
class Model:
    """Weights of the label "good" against "bad" (emission), and the transition scores [from, to]."""

    weights: np.ndarray
    transitions: np.ndarray


def forward_backward(emission: np.ndarray, transitions: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Marginals of "good", those of label pairs (for each line that has one before it: its number and a 2 by 2 table), and each document's log partition sum.

    All documents go forward together, line by line; the longest come first, so those still going are a prefix.
    """
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    length = n_lines[order]
    scores = np.stack((np.zeros(len(emission)), emission), axis=1)
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length.max(initial=0)) + 1)]
    alpha[first] = scores[first]
    for t in range(1, len(alive) - 1):
        at = first[: alive[t]] + t
        alpha[at] = scores[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + transitions, axis=1)
    for t in range(len(alive) - 2, 0, -1):
        at = first[: alive[t]] + t
        beta[at - 1] = np.logaddexp.reduce(transitions + (scores[at] + beta[at])[:, None, :], axis=2)
    z = np.empty(len(n_lines))
    z[order] = np.logaddexp.reduce(alpha[first + length - 1], axis=1)
    each = np.repeat(z, n_lines)
    good = np.exp(alpha[:, 1] + beta[:, 1] - each)
    inner = np.ones(len(emission), bool)
    inner[(np.cumsum(n_lines) - n_lines)] = False
    at = np.flatnonzero(inner)
    joint = np.exp(alpha[at - 1][:, :, None] + transitions + (scores[at] + beta[at])[:, None, :] - each[at][:, None, None])
    return good, (at, joint), z


def chain_marginals(emission: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of "good" along one long chain, by the log odds of the forward and the backward messages: two numbers a line."""
    n, (bad, to_good), (to_bad, good) = len(emission), *transitions.tolist()
    ahead, behind, e = np.empty(n), np.empty(n), emission.tolist()
    top = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    odds = ahead[0] = e[0]
    for t in range(1, n):
        odds = ahead[t] = e[t] + top(to_good, good + odds) - top(bad, to_bad + odds)
    odds = behind[n - 1] = 0.0
    for t in range(n - 1, 0, -1):
        odds = behind[t - 1] = top(to_bad, good + e[t] + odds) - top(bad, to_good + e[t] + odds)
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))


def fit(own: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Adam on the conditional log likelihood of labels that hold for all lines of a document."""
    model = Model(np.zeros(3 * own.shape[1]), np.zeros((2, 2)))
    if not len(labels):
        return model
    x, y = with_neighbours(own, n_lines), np.repeat(labels, n_lines).astype(np.float64)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) / n_lines  # classes and documents count alike
    each = np.repeat(weight, n_lines)
    m1, m2 = np.zeros(model.weights.size + 4), np.zeros(model.weights.size + 4)
    for step in range(1, steps + 1):
        good, (at, joint), _ = forward_backward(x @ model.weights, model.transitions, n_lines)
        seen = np.array([[((1 - y[at]) * each[at]).sum(), 0.0], [0.0, (y[at] * each[at]).sum()]])
        slope = x.T @ ((y - good) * each) - decay * model.weights
        turn = seen - (joint * each[at][:, None, None]).sum(axis=0) - decay * model.transitions
        g = np.concatenate((slope, turn.ravel()))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        model.weights += move[: model.weights.size]
        model.transitions += move[model.weights.size :].reshape(2, 2)
    return model


def emissions(shares: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's score: its own share, that of the line before it for its neighbours and that of the line behind it."""
    out = shares[:, 0].copy()
    last = np.cumsum(n_lines) - 1
    before, behind = shares[:, 1].copy(), shares[:, 2].copy()
    before[last], behind[last - n_lines + 1] = 0, 0
    out[1:] += before[:-1]
    out[:-1] += behind[1:]
    return out


def document_scores(block: list[str], table: np.ndarray, model: Model, long: int = 4_096) -> np.ndarray:
    """The length-weighted mean of the lines' marginals of each text; one of empty lines weighs them alike.

    Features go as soon as a part's shares of the scores are made: what stays of a line is four numbers.
    """
    weights = model.weights.reshape(3, -1).T
    made = [(own @ weights, size, n) for own, size, n in (line_features(x, table) for x in ([[part] for part in parts_of(block[0])] if len(block) == 1 else [block]))]
    shares, size = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    n_lines = np.sum([m[2] for m in made], axis=0) if len(block) == 1 else made[0][2]
    emission, starts = emissions(shares, n_lines), np.cumsum(n_lines) - n_lines
    good, longs = np.empty(len(size)), n_lines > long
    for k in np.flatnonzero(longs).tolist():
        at = slice(starts[k], starts[k] + n_lines[k])
        good[at] = chain_marginals(emission[at], model.transitions)
    rest = np.repeat(~longs, n_lines)
    if rest.any():
        good[rest] = forward_backward(emission[rest], model.transitions, n_lines[~longs])[0]
    weight = np.where(np.repeat(sums(size, starts), n_lines) > 0, size, 1.0)
    return np.clip(sums(good * weight, starts) / sums(weight, starts), 0.0, 1.0)


def blocks(texts: Iterable[str | None], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Lists of texts of about `limit` characters together; a text of that many is on its own."""
    block, held = [], 0
    for text in texts:
        if block and len(text or "") >= limit:
            yield block
            block, held = [], 0
        block.append(text or "")
        held += len(block[-1])
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def held_out(doc_id):
    """Documents that no label is learned from; a null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 3_000, max_lines: int = 512) -> Model:
    """Fits the field on at most `max_train` labelled documents that are not held out, and `max_lines` lines in a row of each.

    Both bound what the driver gathers: max_train * max_lines * 19 numbers of four bytes. Where a longer document's
    lines begin is dealt by the hash of its text. Of several labels of an id the least holds, of several texts of an id
    the least in order.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers are broadcast.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = class_table()
        for batch in batches:
            for quality, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                own, _, _ = long_features(text, table)
                first = zlib.crc32(text.encode()) % max(1, len(own) - max_lines + 1)
                yield {"quality": [quality], "features": [own[first : first + max_lines].astype(np.float32).tobytes()]}

    rows = sorted((bytes(r["features"]), r["quality"]) for r in common.arrow_map(chosen, run, "quality int, features binary").collect())
    own = [np.frombuffer(f, np.float32).reshape(-1, N_BASE) for f, _ in rows]
    return fit(np.concatenate(own or [np.zeros((0, N_BASE))]).astype(np.float64), np.array([len(x) for x in own], np.int64), np.array([q for _, q in rows], np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a column _crf_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = class_table()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            scores = [document_scores(block, table, model) for block in blocks(texts)]
            yield {name: batch.column(k) for k, name in enumerate(batch.schema.names)} | {"_crf_score": np.concatenate(scores) if scores else np.zeros(0)}

    return common.arrow_map(docs, run, StructType([*docs.schema, StructField("_crf_score", DoubleType())]))


def op2_crf(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    score = F.col("_crf_score")
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
