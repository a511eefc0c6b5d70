"""WARC: a content-addressed archive.

An archive is a folder with two tables. `payloads` holds each different payload once, under its
address, the SHA-256 of its bytes. `headers` holds the exact header bytes of every record apart
from its payload. A record is put together again by joining the two, and what is read back is
taken from those bytes: addresses are computed anew from the stored payloads, and a payload that
doesn't match its address stops the reader.

Writing reads the pages once. A task keeps a payload where it first meets it and gathers the pages
of the same payload into one row, so however many pages share a payload, the shuffle sees one row
for each task. Of the tasks that met a payload the lowest keeps it. The records of a payload with very many of them
are dealt into shares, stated beside the payload, so that reading joins them in many tasks.

Defined results: a null payload is empty, and an empty payload is a payload like others. Of records
with equal payloads of at least `least` bytes, the one with the smallest page_id, then url, is the
response and all others revisit it (null page_ids and urls come last); rows that repeat are records
of their own. Smaller payloads are stored once too, but each is a response. Control characters of a
url are percent-encoded in the header line; a null url has no such line. An empty table gives an
empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.llm.jobs import prepare, scratch, stored

#: Payload bytes and pages that a task holds before it gives out rows.
HELD_BYTES, HELD_PAGES = 16 << 20, 50_000
#: Records of one share of a payload, about.
SHARE = 500
_MET = pa.schema([("address", pa.binary()), ("digest", pa.string()), ("size", pa.int64()), ("task", pa.int64()), ("payload", pa.binary()),
                  ("pages", pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string())])))])
_MET_SQL = "address binary, digest string, size long, task long, payload binary, pages array<struct<page_id: long, url: string>>"


@dataclass(frozen=True)
class Archive:
    """Bytes from which on equal payloads are revisited, the date of all records, and the lines before a payload."""

    least: int = 0
    date: str = "1970-01-01T00:00:00Z"
    http: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    profile: str = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's payloads, each once, and the pages of each; the pages of a payload may come in several rows, the payload in the first."""
    task = TaskContext.get().partitionId()
    seen, held, size, pages = set(), {}, 0, 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"address": a, "task": task, **h} for a, h in held.items()], schema=_MET)

    for batch in batches:
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            raw = (html or "").encode()
            address = hashlib.sha256(raw).digest()
            if address not in held:
                new = address not in seen
                seen.add(address)
                size += len(raw) if new else 0
                held[address] = {"digest": sha1_base32(raw), "size": len(raw), "payload": raw if new else None, "pages": []}
            held[address]["pages"].append({"page_id": page_id, "url": url})
            pages += 1
            if size >= HELD_BYTES or pages >= HELD_PAGES:
                yield rows()
                held, size, pages = {}, 0, 0
    if held:
        yield rows()


def _order(page_id: Column, url: Column) -> Column:
    """Null page_ids and urls last."""
    return F.struct(page_id.isNull().alias("no_id"), page_id.alias("page_id"), url.isNull().alias("no_url"), url.alias("url"))


def write(pages: DataFrame, path: str, how: Archive = Archive()) -> None:
    """Write the archive of pages (page_id, url, html) into a folder."""
    prepare(pages.sparkSession)
    met = stored(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_met, _MET_SQL), "met")
    first_page = F.array_min(F.transform("pages", lambda p: _order(p["page_id"], p["url"])))
    known = met.groupBy("address").agg(F.min(F.when(F.col("payload").isNotNull(), F.col("task"))).alias("task"), F.min(first_page).alias("first"), F.ceil(F.sum(F.size("pages")) / SHARE).cast("int").alias("shares"))
    known = stored(known, "known")
    # (address, task) names one stored payload, so no key of this join is shared by two rows
    kept = met.where("payload is not null").join(known.select("address", "task", "shares"), ["address", "task"])
    kept.select("address", "shares", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers(met, known, how).write.option("compression", "zstd").parquet(f"{path}/headers")


def headers(met: DataFrame, known: DataFrame, how: Archive) -> DataFrame:
    """(address, share, header): the bytes of every record before its payload."""
    rows = met.select("address", "digest", "size", "pages").join(known.select("address", "first", "shares"), "address")
    # rows that repeat are numbered by how many equal ones a row of `met` holds, so none is told apart by its place
    each = rows.select("address", "digest", "size", "first", "shares", F.explode("pages").alias("page"))
    same = each.groupBy("address", "digest", "size", "first", "shares", "page").agg(F.count("*").alias("n"))
    each = same.select("address", "digest", "size", "first", "shares", "page.*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    own = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    revisit = (F.col("size") >= how.least) & ((F.col("copy") > 1) | (own != F.col("first")))
    name = lambda page_id, url, copy: F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", F.hex("address"), copy.cast("string"), url), 256), 1, 16), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(label + ": "), value, F.lit("\r\n"))
    safe = F.col("url")
    for code in (*range(32), 127):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit(how.http + "Content-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"), F.col("url"), F.col("copy"))),
        line("WARC-Date", F.lit(how.date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first.page_id"), F.col("first.url"), F.lit(1))), line("WARC-Profile", F.lit(how.profile)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    share = F.pmod(F.xxhash64("page_id", "url", "copy"), F.col("shares")).cast("int")
    return each.select("address", share.alias("share"), F.encode(head, "utf-8").alias("header"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        for address, raw in zip(batch.column("address").to_pylist(), payloads):
            if hashlib.sha256(raw).digest() != address:
                raise ValueError(f"the payload stored as {address.hex()} has changed")
        kept = pa.array([sha1_base32(r) for r in payloads], pa.string()), pa.array([len(r) for r in payloads], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("address"), batch.column("shares"), *kept], ["address", "shares", "payload_digest", "payload_bytes"])


def _in_shares(payloads: DataFrame) -> DataFrame:
    """A row for each share of a payload's records."""
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    return payloads.select("*", shares).drop("shares")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, record): every record's bytes as a WARC file has them; a revisit ends after its headers. Ends with the two empty lines of the format."""
    head = spark.read.parquet(f"{path}/headers")
    is_response = F.col("header").cast("string").contains("\r\nWARC-Type: response\r\n")
    response = head.where(is_response).join(_in_shares(spark.read.parquet(f"{path}/payloads")), ["address", "share"])
    whole = response.select("header", F.concat("header", "payload", F.encode(F.lit("\r\n\r\n"), "utf-8")).alias("record"))
    return whole.unionByName(head.where(~is_response).select("header", F.concat("header", F.encode(F.lit("\r\n\r\n"), "utf-8")).alias("record")))


def originals(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload): the payload of every record, revisits too, from the one place where it is stored."""
    head = spark.read.parquet(f"{path}/headers").select("address", "share", _field("WARC-Record-ID").alias("name"))
    return head.join(_in_shares(spark.read.parquet(f"{path}/payloads")), ["address", "share"]).select(_page(F.col("name")).alias("page_id"), "payload")


def _field(label: str) -> Column:
    """A header line's value; null without such a line. Values hold no line break, so the first line of that name is the record's."""
    return F.regexp_extract(F.col("header").cast("string"), f"(?s)^WARC/.*?\r\n{label}: ([^\r\n]*)\r\n", 1)


def _page(name: Column) -> Column:
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), from the archive's bytes alone."""
    prepare(spark)
    payloads = spark.read.parquet(f"{path}/payloads").mapInArrow(_checked, "address binary, shares int, payload_digest string, payload_bytes long")
    head = spark.read.parquet(f"{path}/headers").select(
        "address", "share", *[_field(n).alias(c) for n, c in (("WARC-Record-ID", "name"), ("WARC-Type", "record_type"), ("WARC-Refers-To", "refers"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "stated"))]
    )
    both = head.join(_in_shares(payloads), ["address", "share"])
    same = F.col("stated") == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header states another digest than its payload has")))
    return both.select(_page(F.col("name")).alias("page_id"), F.nullif("url", F.lit("")).alias("url"), "payload_bytes", digest.alias("payload_digest"), "record_type", _page(F.col("refers")).alias("refers_to"))


def round_trip(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, how)
    return read(spark, path).drop("url")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT unnest(range(8)) AS g),
d AS (SELECT hex, list_reduce(list(list_reduce(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> s) & 31) + 1]), lambda a, b: a || b) ORDER BY g), lambda a, b: a || b) AS digest
      FROM (SELECT hex, g, list_reduce(list_transform(range(1, 6), lambda i: CAST(instr('0123456789abcdef', hex[5 * g + i]) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS n FROM (SELECT DISTINCT hex FROM p), g) GROUP BY hex),
f AS (SELECT page_id, html, hex, row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to
FROM f JOIN d USING (hex)
"""
