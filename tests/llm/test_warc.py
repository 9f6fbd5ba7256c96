"""Pages through archives against a plain version; odd tables; the fields that the format asks for."""

import base64
import gzip
import hashlib
from pathlib import Path

import duckdb

from spanloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), least.get(h or "")
        response = to is None or i == to
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else to))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r.verified for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


def test_different_pages_of_one_id(spark):
    rows = [(7, "u", "y"), (7, "v", "zz"), (8, "u", "y"), (9, None, "zz")]
    assert found(warc.archived(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_nulls_repeated_rows_and_long_pages(spark):
    rows = [(None, "u", "a"), (None, None, "b"), (None, None, "b"), (3, "u", None), (4, "u", ""), (5, "u", "a"), (5, "u", "a"), (6, "u", "x\r\n\r\nWARC/1.1\r\n" * 9_000), (1, "u v", "é" * 70_000), (2, "", "é" * 70_000)]
    assert found(warc.archived(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "u", "a"), (2, "u", "a")]
    df = spark.createDataFrame([(*r, 9, "p", "q") for r in rows], f"{SCHEMA}, digest long, payload string, refers_to string")
    assert found(warc.archived(df)) == plain(rows)


def test_types_of_the_table(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert found(queries.QUERIES["op4_warc"](spark, "/root/testdata/sf0.01")) == plain(rows)


def test_archives_have_the_fields(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k % 7} " * 400) for k in range(60)]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2), str(tmp_path / "w"), segment_bytes=1_000, max_records=25)
    files = sorted(Path(tmp_path / "w").glob("*.gz"))
    assert len(files) > 2
    for f in files:
        parts = gzip.decompress(f.read_bytes()).split(b"\r\n\r\nWARC/1.1\r\n")
        assert len(parts) <= 25
        assert b"WARC-Type: warcinfo" in parts[0]
        for x in parts[1:]:
            head = x.partition(b"\r\n\r\n")[0]
            assert b"WARC-Target-URI: http://h/" in head and b"WARC-Record-ID: <urn:uuid:" in head
            assert b"revisit" not in head.splitlines()[0] or b"WARC-Refers-To-Target-URI: http://h/" in head
    assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == list(range(60))


def test_records_at_the_end_of_the_readers_buffer(spark, tmp_path):
    """Marks at each place around the 65,536th byte: none is overlooked, and the rows behind it stay."""
    for k in range(48):
        rows = [(0, b"x" * (65_536 - 650 + k)), (1, b"second"), (2, b"third")]
        out = [x for i, p in rows for x in warc.records(i, f"http://h/{k:02d}", p, None, None, f"{k}/{i}", 1 << 20, 1 << 20)]
        raw = b"".join(warc.VERSION + x + b"\r\n\r\n" for x in [warc.warcinfo(str(k)), *out])
        assert abs(raw.find(b"\r\n\r\nWARC/1.1", 60_000) - 65_536) < 60
        (tmp_path / f"{k:02d}.warc").write_bytes(raw)
    found = warc.read_warc(spark, str(tmp_path)).groupBy("target_uri").count().collect()
    assert sorted((r[0], r[1]) for r in found) == [(f"http://h/{k:02d}", 3) for k in range(48)]
