"""WARC archives: writing, reading, and putting segmented records together again.

Writing: Spark's text sink writes the records, so archives land on any file system that Spark knows and a lost
task is written anew by the commit protocol. Each page is an HTTP response in chunked transfer framing. A block
longer than `segment_bytes` is cut into a first record and continuation records, which carry the origin's id, a
segment number and, in the last one, the total length. Of equal payloads (same SHA-1 and length) of at least
`min_bytes` bytes the one with the smallest page_id is stored; the others are revisit records without a payload.

Reading: a task reads an archive (gzip cannot be split, so archives hold a bounded number of records) and cuts it at
the record mark. The writer ends a chunk
inside any version line that occurs in a payload, so a block never holds a mark. Continuation records are grouped by
origin id, ordered by segment number, checked against the total length, joined and only then decoded.

Defined cases: null pages have the empty payload; null ids are written and read as null (a null id revisits a
known equal page); repeated rows are separate records, and rows that repeat the smallest id are responses all;
empty tables give empty archives; extra columns are ignored. Damaged segment lists raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common

VERSION = b"WARC/1.1\r\n"
#: What records are cut at. No part of it but the last byte repeats its first one: Hadoop's line reader overlooks a
#: separator that begins inside a partial match (as of \r\n\r\n in \r\n\r\n\r\n) at the end of its buffer.
MARK = b"\n" + VERSION
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits as eight groups of 20 bits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing; a chunk ends inside every version line of the payload, so that no block holds a record mark."""
    cuts = {*range(0, len(payload), chunk_bytes), len(payload)}
    at = payload.find(VERSION)
    while at >= 0:
        cuts.add(at + 2)
        at = payload.find(VERSION, at + 1)
    out, ends = [], sorted(cuts)
    for a, b in zip(ends, ends[1:], strict=False):
        out += [b"%X\r\n" % (b - a), payload[a:b], b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the mark before and behind it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def warcinfo(serial: str) -> bytes:
    """The record that an archive begins with."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'info/{serial}')}>"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def records(page_id, url: str | None, payload: bytes, refers_to, refers_uri: str | None, serial: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, serial)}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url, refers_uri = ("".join((x or "").split()) or None for x in (url, refers_uri))
    common_fields = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common_fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", refers_uri), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", refers_to)], b"")
        return
    block = HTTP + chunked(payload, chunk_bytes)
    n = max(1, -(-len(block) // segment_bytes))
    first = [("WARC-Segment-Number", 1)] if n > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common_fields, ("Content-Type", "application/http; msgtype=response"), *first], block[:segment_bytes])
    for k in range(1, n):
        last = [("WARC-Segment-Total-Length", len(block))] if k == n - 1 else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}-{k + 1}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), *last], block[k * segment_bytes : (k + 1) * segment_bytes])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4_096, max_records: int = 20_000) -> None:
    """Writes pages (page_id, url, html) as gzip-compressed archives of at most max_records records, a warcinfo record first."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    ids = base.filter(F.col("n") >= min_bytes).select("page_id", "url", "digest", "n")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = ids.groupBy("digest", "n").agg(least.alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "n", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri"))
    revisits = ids.join(first, ["digest", "n"]).filter("NOT page_id <=> refers_to").dropDuplicates(["page_id", "digest"]).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", "refers_uri")
    found = base.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "refers_to", "refers_uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, k, written = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out: list[bytes] = []
            for page_id, url, payload, refers_to, refers_uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k += 1
                for x in records(page_id, url, payload, refers_to, refers_uri, f"{part}/{k}/{page_id}", segment_bytes, chunk_bytes):
                    if written % max_records == 0:  # the sink begins another file here
                        out.append(warcinfo(f"{part}/{written}"))
                        written += 1
                    out.append(x)
                    written += 1
                if len(out) >= 256:
                    yield {"value": [VERSION + x + b"\r\n" for x in out]}
                    out = []
            yield {"value": [VERSION + x + b"\r\n" for x in out]}

    # A row ends in \r\n and so does the sink's line: together the two empty lines behind a record.
    lines = common.arrow_map(found, run, "value binary").select(F.col("value").cast("string").alias("value"))
    with common.shuffle_cleanup(pages.sparkSession):
        lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


PARSED = "record_id string, warc_type string, origin_id string, segment long, total long, page_id long, refers_to long, target_uri string, digest string, payload binary"


def parse(raw: bytes) -> dict:
    """The named fields and the block of one record, checked against its length."""
    head, _, block = raw.removeprefix(VERSION).partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if len(block) < size or block[size:].strip():
        raise ValueError(f"record {fields.get('warc-record-id')}: {len(block)} bytes, not {size}")
    return fields | {"block": block[:size]}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; payload: the HTTP payload of whole records, the bare block of segments."""
    # A row is what lies between two marks: the first of a file has VERSION before it, all have empty lines behind them.
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    number = lambda x: int(x) if x is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = [parse(x) for x in batch.column(0).to_pylist() if x.strip()]
            yield {
                "record_id": [r.get("warc-record-id") for r in rows],
                "warc_type": [r.get("warc-type") for r in rows],
                "origin_id": [r.get("warc-segment-origin-id") or (r.get("warc-record-id") if "warc-segment-number" in r else None) for r in rows],
                "segment": [number(r.get("warc-segment-number")) for r in rows],
                "total": [number(r.get("warc-segment-total-length")) for r in rows],
                "page_id": [number(r.get("x-page-id")) if r.get("x-page-id") != "None" else None for r in rows],
                "refers_to": [number(r.get("x-refers-to-page")) for r in rows],
                "target_uri": [r.get("warc-target-uri") for r in rows],
                "digest": [(r.get("warc-payload-digest") or "").removeprefix("sha1:") or None for r in rows],
                "payload": [http_payload(r["block"]) if r.get("warc-type") == "response" and "warc-segment-number" not in r else r["block"] for r in rows],
            }

    return common.arrow_map(lines, run, PARSED)


def reassemble(segments: DataFrame) -> DataFrame:
    """Joins the segments of each origin in order; a gap, a double or a wrong total length raises an error."""
    parts = F.sort_array(F.collect_list(F.struct("segment", "total", "payload")))
    first = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "warc_type", "page_id", "refers_to", "target_uri", "digest")}
    grouped = segments.groupBy("origin_id").agg(parts.alias("parts"), F.max("total").alias("length"), *first.values())
    block = F.aggregate("parts", F.lit(b""), lambda whole, x: F.concat(whole, x["payload"]))
    in_order = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    sound = F.coalesce(in_order & (F.octet_length("block") == F.col("length")), F.lit(False))
    joined = grouped.withColumn("block", block).withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("incomplete record "), "origin_id"))))
    whole = joined.select("record_id", "warc_type", "page_id", "refers_to", "target_uri", "digest", F.col("block").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            yield out | {"payload": [http_payload(x) for x in batch.column("payload").to_pylist()]}

    return common.arrow_map(whole, run, "record_id string, warc_type string, page_id long, refers_to long, target_uri string, digest string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, warc_type, page_id, refers_to, target_uri, digest (as written), payload; segmented records are whole again."""
    found = read_records(spark, path).filter("warc_type <> 'warcinfo'")
    whole = found.filter("segment IS NULL").select("record_id", "warc_type", "page_id", "refers_to", "target_uri", "digest", "payload")
    return whole.unionByName(reassemble(found.filter("segment IS NOT NULL")))


def archived(pages: DataFrame, salts: int = 16) -> DataFrame:
    """Writes all pages, reads them back and reports each; a revisit's size and digest are those of the response it refers to.

    Many revisits may refer to one response: those rows are spread by a salt, and the responses that are referred to
    are repeated for each of its values. A response is known by its page's id and digest.
    """
    spark = pages.sparkSession
    path = common.new_path(spark, "archives")
    write_warc(pages, path)
    back = read_warc(spark, path).select("page_id", "warc_type", "refers_to", F.col("digest").alias("said"), F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("own"))
    rows, _ = common.written(back, "records")
    common.remove(spark, path)
    salt = F.pmod(F.xxhash64("page_id", "said"), F.lit(salts)).cast("int")
    referred = rows.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("of_id"), F.col("said").alias("of_said")).distinct()
    responses = rows.filter("warc_type = 'response'").select(F.col("page_id").alias("of_id"), F.col("said").alias("of_said"), F.col("n").alias("of_n"), F.col("own").alias("of_own"))
    sources = referred.join(responses, ["of_id", "of_said"]).dropDuplicates(["of_id", "of_said"]).withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col("refers_to") == F.col("of_id")) & (F.col("said") == F.col("of_said")) & (F.col("salt") == F.col("of_salt"))
    revisits = rows.filter("warc_type = 'revisit'").withColumn("salt", salt).join(sources, same, "left")
    out = lambda df, n, own: df.select("page_id", F.col(n).alias("payload_bytes"), F.col(own).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to", (F.col(own) == F.col("said")).alias("verified"))
    return out(rows.filter("warc_type = 'response'"), "n", "own").unionByName(out(revisits, "of_n", "of_own"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return archived(common.table(spark, sf_dir, "pages"))
