"""Texts of over a megabyte, copies of them among them, through the queries: held against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from spanloom.llm import queries, tokens

SPACE = "\x20\x09-\x0d"
RNG = np.random.default_rng(7)
VOCABULARY = np.array(["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzé"), RNG.integers(2, 12))) for _ in range(5000)])
LINES = [" ".join(VOCABULARY[RNG.integers(0, 5000, 12)]) for _ in range(15_000)]
LONG = "\n".join(LINES)
CYCLE = " ".join(VOCABULARY[:10].tolist() * 25_000)
# 3 is the same as 20 and 40 but for a line more; 21 is one long period. None of these ids is edited by op11.
DOCS = {3: LONG + "\nOne line more than the others have.", 20: LONG, 40: LONG, 21: CYCLE, 22: "x" * 1_500_000, 23: ""}
assert all(zlib.crc32(str(k).encode()) % 10 for k in (3, 20, 21, 22)) and min(len(DOCS[k]) for k in (3, 20, 21, 22)) > 1_000_000


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    pq.write_table(pa.table({"doc_id": list(DOCS), "text": list(DOCS.values()), "lang": ["en"] * len(DOCS), "source": ["s"] * len(DOCS), "n_chars": [len(t) for t in DOCS.values()]}), folder / "documents.parquet")
    made = {}

    def rows(name):
        if name not in made:
            made[name] = {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(folder)).collect()}
            assert made[name].keys() == DOCS.keys()
        return made[name]

    return rows


def words(text):
    return re.findall(f"[^{SPACE}]+", text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tokens(found):
    encoding, _ = tokens.encoder(tokens.VOCABULARY)
    for k, r in found("op1_tokens").items():
        assert r.n_tokens == len(encoding.encode_ordinary(DOCS[k])) == sum(r.section_tokens)


def test_rules(found):
    for k, r in found("op5_line_frequency").items():
        w = words(DOCS[k])
        lines = [x for x in DOCS[k].split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        hit = np.zeros(len(w) + 3, bool)
        for i, x in enumerate(windows):
            if seen[x] > 1:
                hit[i : i + 3] = True
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), int(hit.sum()))


def test_suffixes(found):
    got = found("op7_suffixes")
    for k, text in DOCS.items():
        size = len(text.encode())
        gone = size if k in (20, 40) else 0
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (size, gone, int(gone > 0))
        assert got[k].kept_sha256 == sha("" if gone else text)


def test_mixing(found):
    got = found("op8_mixing")
    assert {k: r.size for k, r in got.items()} == {k: len(words(t)) for k, t in DOCS.items()}
    assert sum(r.taken for r in got.values()) == pytest.approx(sum(len(words(t)) for t in DOCS.values()), rel=0.01)


def plain_print(text):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def test_simhash(found):
    got = found("op9_simhash")
    prints = {k: plain_print(t) for k, t in DOCS.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    for k, p in prints.items():
        assert got[k].component_id == min(j for j, q in prints.items() if (p ^ q).bit_count() <= 3)


def test_fingerprints(found):
    got, order = found("op10_fingerprints"), sorted(DOCS, reverse=True)
    for k, following in zip(order, [*order[1:], order[0]], strict=True):
        half = len(DOCS[k]) // 2
        assert got[k].n_chars == len(DOCS[k])
        assert got[k].edited_sha256 == sha(DOCS[k][: len(DOCS[k]) - half] + DOCS[following][:half])
        assert 0 <= got[k].near_next <= 1
    assert got[20].fingerprint == got[40].fingerprint and got[20].near_next > 0.99


def test_runs(found):
    got = found("op11_runs")
    assert (got[21].n_runs, got[21].start, got[21].length, got[21].period, got[21].exponent_milli) == (1, 0, 250_000, 10, 25_000_000)
    assert got[21].collapsed_sha256 == sha(" ".join(VOCABULARY[:10]))
    for k in (3, 20, 22, 23):
        assert got[k].n_runs == 0 and got[k].collapsed_sha256 == sha(" ".join(words(DOCS[k])))


def test_lines(found):
    # No line is in ten documents.
    for k, r in found("op12_line_levels").items():
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (DOCS[k].count("\n") + 1, 0, sha(DOCS[k]))
