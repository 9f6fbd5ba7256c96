"""The pipeline stage by stage and as a whole against a plain version, and on odd and empty tables with clashing columns."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import common, crf, mixing, pieces, simhash

DATA = "/root/testdata/sf0.001"
CLASHING = ["kept", "n_removed", "row", "document", "text_hash", "size", "taken", "copy", "was_null", "carried_0", "component_id", "stays", "shingles", "a b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles_of(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def plain_near(rows, least=0.8):
    """Rows (id, text, ...) that stay: of each component of pairs that are alike the least id."""
    sets = [shingles_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    by_size = sorted(range(len(rows)), key=lambda k: len(sets[k]))
    for n, a in enumerate(by_size):
        for b in by_size[n + 1 :]:
            if len(sets[a]) < least * len(sets[b]) - 1e-9:
                break
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                root[max(u, v, key=lambda k: rows[k][0])] = min(u, v, key=lambda k: rows[k][0])
    return [r for k, r in enumerate(rows) if find(k) == k]


def plain_passages(rows, depth=50):
    raws = {r[0]: (r[1] or "").encode() for r in rows}
    seen = {}
    for i in sorted(raws):
        for q in range(len(raws[i]) - depth + 1):
            seen.setdefault(raws[i][q : q + depth], i)
    out = []
    for r in rows:
        raw = raws[r[0]]
        gone = np.zeros(len(raw), bool)
        for q in range(len(raw) - depth + 1):
            if seen[raw[q : q + depth]] < r[0]:
                gone[q : q + depth] = True
        text, at = "", 0
        for c in raw.decode():
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        if not gone.any() or words_of(text):
            out.append((r[0], text, *r[2:]))
    return out


def plain_mixture(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[2]) for r in rows])
    taken = {i: (size, n) for i, size, _, _, n in con.sql(mixing.OP8_SQL).fetchall()}
    out = []
    for r in rows:
        size, left = taken[r[0]]
        while left > 0:
            ends = [m.end() for m in re.finditer("[^\x20\x09-\x0d]+", r[1])]
            out.append((r[0], r[1] if left >= size else r[1][: ends[left - 1]], r[2]))
            left -= size
    return out


def texts(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_run_against_a_plain_version(spark):
    docs = common.table(spark, DATA, "documents")
    model = crf.train(docs, common.table(spark, DATA, "labels"))
    table = crf.class_table()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    plain = {"quality": [r for r in rows if crf.document_scores([r[1] or ""], table, model)[0] >= crf.THRESHOLD]}
    plain["near_dedup"] = plain_near(plain["quality"])
    plain["passages"] = plain_passages(plain["near_dedup"])
    plain["mixture"] = plain_mixture(plain["passages"])
    sizes = [len(rows), *(len(x) for x in plain.values())]
    assert sizes[0] > sizes[1] > sizes[2] > 0  # the stages act here
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = common.written(stage(spark, docs, DATA), name)
        assert texts(docs) == Counter(plain[name]), name
    vocabulary = pieces.Pieces(pieces.MODEL)
    said = Counter()
    for i, text, _ in plain["mixture"]:
        best = vocabulary.encode(text)[0][1]
        said[i, len(best) // 2, hashlib.sha256(best).hexdigest()] += 1
    found = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.n_pieces, r.ids_sha256) for r in found) == said
    assert all(r.round_trip for r in found)


def test_near_duplicates_of_a_larger_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert found == {r[0] for r in plain_near(rows)}
    assert len(found) < len(rows)


def odd_rows():
    fill = tuple(f"v{k}" for k in range(len(CLASHING)))
    base = "the quick brown fox jumps over the lazy dog and runs away from here to there"
    found = [(1, base), (1, "an entirely different text that bears the same id as the one before it"), (2, base), (3, None), (4, ""), (5, " \n "), (None, base), (None, base), (6, "é" * 40 + " " + "ü" * 40), (7, "x" + "é" * 40 + " " + "ü" * 40), (8, "word " * 400), (8, "word " * 400)]
    return [(i, t, None, None if k % 2 else "s", None if t is None else len(t), *fill) for k, (i, t) in enumerate(found)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df, empty = spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, DATA).collect() == []
    found = stage(spark, df, DATA)
    rows = found.collect()
    if name == "pieces":
        assert len(rows) == len(odd_rows()) and all(r.round_trip for r in rows)
        return
    assert found.dtypes == df.dtypes
    assert all(tuple(r)[5:] == tuple(f"v{k}" for k in range(len(CLASHING))) for r in rows)
    assert name == "quality" or all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)


def test_near_dedup_of_odd_rows(spark):
    found = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(odd_rows(), SCHEMA), "").collect())
    rows = odd_rows()
    # Empty sets are alike: of 3, 4 and 5 the least id stays. Both texts of id 1 stay, and both rows without an id.
    assert found == Counter([(1, rows[0][1]), (1, rows[1][1]), (3, None), (None, rows[0][1]), (None, rows[0][1]), (6, rows[8][1]), (7, rows[9][1]), (8, rows[10][1])])


def test_passages_cut_whole_characters(spark):
    rows = [r for r in odd_rows() if r[0] in (6, 7)]
    found = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert found == {6: rows[0][1], 7: "x"}
    # A window that ends inside of a character: the half of it stays whole.
    split = [(1, "a" * 49 + "é"), (2, "b" + "a" * 49 + "è")]
    df = spark.createDataFrame([(i, t, None, None, len(t), *["v"] * len(CLASHING)) for i, t in split], SCHEMA)
    assert {r.doc_id: r.text for r in corpus_pipeline.passages(spark, df, "").collect()} == {1: split[0][1], 2: "bè"}


def test_mixture_keeps_line_breaks(spark):
    rows = [(1, "a b\n\nc\td  e\n", "s"), (2, " x\ny z", "t"), (3, "p q r s t u v w", "u")]
    df = spark.createDataFrame([(i, t, None, s, len(t), *["v"] * len(CLASHING)) for i, t, s in rows], SCHEMA)
    assert texts(corpus_pipeline.mixture(spark, df, "")) == Counter(plain_mixture(rows))


def test_texts_that_share_a_phrase_are_kept_apart(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(300))
    rows = [(k, "a " * 400 + own(k)) for k in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.stays for r in simhash.similar_documents(df).collect()] == [True, True]


def test_large_groups_are_dealt_to_parts(spark):
    base = [f"b{k}" for k in range(84)]
    rows = [(i, " ".join(base + [f"p{i // 2}x{k}" for k in range(10)] + [f"o{i}x{k}" for k in range(10)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df, most=16).collect()} == {i: i // 2 * 2 for i in range(120)}
