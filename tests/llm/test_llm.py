"""The ten operators against plain versions, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
import zlib
from itertools import product

import duckdb
import numpy as np
import pytest

from spanloom.llm import common, components, crf, extraction, mixing, pieces, queries, rules, simhash, sketches, suffixes, tokens, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, score string"
LONG = "the quick brown fox jumps over the lazy dog and runs away from here " * 300
TEXTS = [(1, "Hello there, world. It is a fine day.\nA second line."), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (5, LONG), (6, "Hello there, world. It is a fine day.\nA second line."), (None, "no id é ü \U0001F600 ▁ x"), (7, "!!! ### | |")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", None, 1, "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


OPERATORS = {
    "tokens": tokens.attribute,
    "pieces": pieces.encode,
    "rules": rules.line_rules,
    "suffixes": suffixes.repeated_passages,
    "mixing": mixing.mix,
    "simhash": simhash.near_duplicates,
    "sketches": sketches.fingerprints,
    "crf": lambda d: crf.scored(d, crf.Model(np.zeros(3 * crf.N_BASE), np.zeros((2, 2)))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, empty, name):
    assert len(OPERATORS[name](odd).collect()) == len(TEXTS)
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, said = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    key = lambda columns, r: tuple(sorted(zip(columns, r, strict=True)))
    assert sorted(key(df.columns, r) for r in df.collect()) == sorted(key(said.columns, r) for r in said.fetchall())


def test_allocation_rules():
    first, last, starts = np.array([0, 3, 8]), np.array([2, 7, 9]), np.array([0, 4])
    assert tokens.allocate(first, last, starts)[0].tolist() == [0, 0, 1]
    assert tokens.allocate(first, last, starts, "end")[0].tolist() == [0, 1, 1]
    assert tokens.allocate(first, last, starts, "majority")[0].tolist() == [0, 1, 1]
    assert tokens.allocate(first, last, starts)[1].tolist() == [False, True, False]


def test_token_spans_inside_characters():
    assert [x.tolist() for x in tokens.token_spans("aéb".encode(), np.array([2, 1, 1]))] == [[0, 1, 2], [1, 1, 2]]


def test_section_tokens_sum_up(spark):
    for r in queries.QUERIES["op1_tokens"](spark, DATA).collect():
        assert sum(r.section_tokens) == r.n_tokens
        assert len(r.section_tokens) == r.n_sections


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emission, transitions, lines = rng.normal(size=6), rng.normal(size=(2, 2)), np.array([4, 2])
    good, _, z = crf.forward_backward(emission, transitions, lines)
    at = 0
    for k, n in enumerate(lines):
        e, total, ones = emission[at : at + n], 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(e[t] * y[t] for t in range(n)) + sum(transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
        assert np.log(total) == pytest.approx(z[k])
        assert good[at : at + n] == pytest.approx(ones / total)
        at += n


def test_held_out_accuracy(spark):
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    found = [r for r in queries.QUERIES["op2_crf"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.95


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.MODEL)


def segmentations(p, text):
    s, out = " " + text, []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        if "▁" == s[i] or s[i].replace(" ", "▁") not in p.id_of:
            go(i + 1, score + p.unknown, [*ids, *(p.bytes_at + b for b in s[i].encode())])
        for n in range(1, min(p.longest, len(s) - i) + 1):
            if "▁" not in s[i : i + n] and (k := p.id_of.get(s[i : i + n].replace(" ", "▁"))) is not None:
                go(i + n, score + p.score[k], [*ids, k])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello", "a b\nc", "  x", "é ü", "x▁y", "\U0001F600 a", " ", "\n", "the other", "aaaa aa"])
def test_nbest_against_enumeration(vocabulary, text):
    found, said = vocabulary.encode(text, 5), segmentations(vocabulary, text)[:5]
    assert [s for s, _ in found] == pytest.approx([s for s, _ in said])
    assert len({ids for _, ids in found}) == len(found)
    assert all(vocabulary.decode(ids) == text for _, ids in found)


def test_encoding_round_trip(spark, odd):
    assert all(r.round_trip for r in queries.QUERIES["op3_pieces"](spark, DATA).collect())
    assert {r.text for r in pieces.decode(pieces.encode(odd)).collect()} == {t or "" for _, t in TEXTS}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, None), (3, "u", "<p>x</p>"), (4, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 900), (5, "u", ""), (6, "u", "é" * 20_000), (None, "u", "<p>x</p>"), (7, "u", "y"), (7, "u", "y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"), segment_bytes=5_000, chunk_bytes=777)
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == 9
    whole = {r.page_id: bytes(r.payload).decode() for r in back if r.warc_type == "response"}
    assert whole == {r.page_id: r.html or "" for r in pages.collect() if r.page_id in (1, 2, 4, 6, 7)}
    assert {(r.page_id, r.refers_to) for r in back if r.warc_type == "revisit"} == {(3, 1), (5, 2), (None, 1)}


def test_warc_gap_is_an_error(spark):
    rows = [("o", "o", "response", 1, None, b"ab"), ("o-3", "o", "continuation", 3, 6, b"ef")]
    df = spark.createDataFrame(rows, "record_id string, origin_id string, warc_type string, segment long, total long, payload binary")
    for c in ("page_id", "refers_to"):
        df = df.selectExpr("*", f"CAST(NULL AS LONG) AS {c}")
    with pytest.raises(Exception, match="incomplete record"):
        warc.reassemble(df.selectExpr("*", "CAST(NULL AS STRING) AS target_uri", "CAST(NULL AS STRING) AS digest")).collect()


def test_op4(spark):
    html = dict(duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{DATA}/pages.parquet'").fetchall())
    found = queries.QUERIES["op4_warc"](spark, DATA).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in found} == {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in html.items()}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href='/'>menu</a></nav><article><h1>T &amp; t</h1><p>one\n two<p>three</article><footer>f</footer>", "T & t\none two\nthree"),
        ("<div class='ad'>buy this now</div><article><p>x</article><div id='comments'><p>first!</div>", "x"),
        ("<script>var t='</p>';</script><main><p>body text</p><form><p>mail</p></form></main>", "body text"),
        ("<body><p>" + "word " * 50 + "</p></body>", ("word " * 50).strip()),
    ],
)
def test_main_text(html, text):
    assert extraction.main_text(html) == text


def test_short_lines_of_an_article_stay():
    cells, long = ["ab", "abc", "abcd", "abcde", "ab", "abc"], ["x" * n for n in (500, 450, 600, 500, 450)]
    html = "<p>{}</p><p>{}</p><p>{}</p><table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table><p>{}</p><p>{}</p><section><h2>End</h2></section><section><div><p>Short.</p></div></section>"
    expected = "\n".join(long[:3] + cells + long[3:] + ["End", "Short."])
    for name in ("article", "main", "div"):
        page = f"<nav>menu</nav><{name}>{html.format(*long)}</{name}><footer>f</footer>"
        assert extraction.main_text(page) == expected


def test_extraction_of_a_table(spark, pages):
    assert len(extraction.extract(pages).collect()) == 9


def test_repeated_passages(spark, docs):
    seen, said = {}, {}
    for i, t in docs:
        raw = t.encode()
        for q in range(len(raw) - 49):
            seen.setdefault(raw[q : q + 50], i)
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for q in range(len(raw) - 49):
            if seen[raw[q : q + 50]] < i:
                gone[q : q + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        said[i] = (len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op7_suffixes"](spark, DATA).collect()} == said


def test_suffix_order_with_long_ties():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice([97, 98], 200).tolist()) for _ in range(4)]
    texts += [texts[0][:150], b"ab" * 90, b"a" * 120]
    s = suffixes.Suffixes(texts, 50)
    data = b"".join(texts)
    least = s.least(np.arange(len(texts)))
    for q in s.windows.tolist():
        assert least[q] == min(k for k, t in enumerate(texts) if data[q : q + 50] in t)


def test_golay_keys_are_complete():
    golay, rng = simhash.Golay(), np.random.default_rng(2)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    pairs = [set(zip(*(v.tolist() for v in golay.bucket_keys(z)), strict=True)) for z in (x, y)]
    assert {r for r, _ in pairs[0] & pairs[1]} == set(range(500))


def test_op9(spark, docs):
    import xxhash

    prints = {}
    for i, t in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in (zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words] if words else [])]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op9_simhash"](spark, DATA).collect()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_features_of_a_long_text_in_parts():
    table, text = crf.class_table(), "One line here.\n\nAnother!! ### 12\n" * 40
    for found, want in zip(crf.long_features(text, table, 50), crf.line_features([text], table), strict=True):
        assert np.array_equal(found, want)
    assert [len(b) for b in crf.blocks(["a", None, "b" * 9, "c"], 5)] == [2, 1, 1]


def test_similar_documents(spark, odd, empty):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    sets, rows = {}, []
    for k in range(60):
        base = [word() for _ in range(300)]
        for j, edits in enumerate((0, 0, 2, 5, 12, 40)):
            words = list(base)
            for at in rng.choice(300, edits, replace=False):
                words[at] = word()
            rows.append((6 * k + j, " ".join(words).title() if j == 1 else " ".join(words)))
            sets[6 * k + j] = {tuple(words[i : i + 5]) for i in range(296)}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i // 6 * 6, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u, v = root[i], root[j]
                root = {k: min(u, v) if r in (u, v) else r for k, r in root.items()}
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] != root[i] for i in sets) <= 2
    assert all(found[i] >= root[i] for i in sets)  # nothing is linked that is not alike
    assert sorted((r.doc_id, r.component_id) for r in simhash.similar_documents(odd).collect()) == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (5, 5), (6, 1), (7, 7)]
    assert simhash.similar_documents(empty).collect() == []


def linked(spark, texts):
    """component_id of each text, by its number."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}


def test_alike_pairs_among_loose_relatives(spark):
    # 80 shingles of all, 10 of a pair, 10 of its own: 90 of 110 in a pair, 80 of 120 else.
    base = [f"b{k}" for k in range(84)]
    texts = [" ".join(base + [f"p{i // 2}x{k}" for k in range(10)] + [f"o{i}x{k}" for k in range(10)]) for i in range(800)]
    assert linked(spark, texts) == {i: i // 2 * 2 for i in range(800)}


def test_a_much_repeated_line_makes_no_copies(spark):
    line = " ".join(f"line{k}" for k in range(11))
    texts = [" ".join(f"o{i}x{k}" for k in range(100)) + f" {line}" * 100 for i in range(20)]
    assert linked(spark, texts) == {i: i for i in range(20)}


def test_a_copy_that_repeats_a_line(spark):
    line = " ".join(f"line{k}" for k in range(10))
    base = [" ".join(f"b{i}x{k}" for k in range(300)) for i in range(20)]
    texts = [x for text in base for x in (text, text + f" {line}" * 40)]
    assert linked(spark, texts) == {i: i // 2 * 2 for i in range(40)}


def test_short_copies_at_the_limit(spark):
    # 4 and 5 shingles, 4 of them shared.
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(8 + i % 2)) for i in range(600)]
    assert linked(spark, texts) == {i: i // 2 * 2 for i in range(600)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(90, 91)], "u long, v long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {**{k: 0 for k in range(51)}, 90: 90, 91: 90}


def test_op10(spark, docs):
    shingles = lambda t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.split()) > 4 else {tuple(w)} if w else set()
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order, found = docs[::-1], {r.doc_id: r for r in queries.QUERIES["op10_fingerprints"](spark, DATA).collect()}
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].near_edited == pytest.approx(alike(shingles(t), shingles(edited)), abs=0.17)
        assert found[i].near_next == pytest.approx(alike(shingles(t), shingles(nxt)), abs=0.17)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA)
        docs, _ = common.written(docs, name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes
        if name in ("quality", "near_dedup"):
            assert docs.join(before, before.columns, "left_semi").count() == docs.count() > 0
    assert docs.filter("NOT round_trip").count() == 0


def test_wide_keys_are_complete(spark):
    golay, rng = simhash.Golay(), np.random.default_rng(8)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    pairs = [set(zip(*(v.tolist() for v in golay.bucket_keys(z, True)), strict=True)) for z in (x, y)]
    assert {r for r, _ in pairs[0] & pairs[1]} == set(range(300))
    prints = spark.createDataFrame([(int(v),) for v in np.concatenate((x, y)).view(np.int64)], "print long").distinct()
    found = [sorted(map(tuple, components.components(simhash.links(prints, wide=w)).collect())) for w in (False, True)]
    assert found[0] == found[1]


def test_mixing_of_null_ids_against_sql(spark, tmp_path):
    rows = [(None if k % 3 else k, f"word {k} " * (k % 9), None if k % 5 == 0 else f"s{k % 4}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    said = sorted(con.sql(mixing.OP8_SQL).fetchall(), key=str)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == said
