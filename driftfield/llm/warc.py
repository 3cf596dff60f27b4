"""WARC archives over a content-addressed store of payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import column, new_path, table

END = "\r\n"
VERSION = "WARC/1.1"
#: Up to this many digests (about 100 bytes each) of payloads that occur more than once are broadcast.
BROADCAST_DIGESTS = 200_000
#: Payloads up to so many bytes go to files of at most so many records, so that a reader holds a bounded file of about 64 MB; larger ones have their own.
CLASSES = ((1 << 16, 1000), (1 << 22, 16))
#: Bytes of payloads in a batch of records read back.
BATCH = 4 << 20
#: One date for all records: archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 form of a SHA-1 digest, without Python: 40 bits become 8 digits at a time."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in range(1, 41, 10)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("none"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def plan(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with their payload, its digests, and the page that keeps it.

    Equal payloads meet by SHA-256 with a partial maximum of page_id; only digests
    move. Pages are then joined to the digests that occur more than once, which
    are broadcast while they are few, so that pages stay where they are.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    raw = F.encode("payload", "UTF-8")
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), base32_sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))
    kept = rows.where(F.col("n") >= min_bytes).groupBy("sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    kept = table(kept.where("copies > 1").drop("copies"), "warc-copies")
    few = kept.count() <= BROADCAST_DIGESTS
    return rows.join(F.broadcast(kept) if few else kept, "sha256", "left")


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a WARC record per page to ``path``, as gzip files of bounded size (``CLASSES``).

    Of records with equal payloads of at least ``min_bytes`` bytes, that of the
    largest page_id is a response and the others are revisits that refer to it;
    smaller payloads are all responses. Null html is an empty payload; a null
    page_id is the smallest, and without another every such page is a response;
    rows that repeat the largest page_id are all responses. A null url is left
    out, and control characters in one are escaped. An empty table gives no
    records; other columns are not read.
    """
    rows = plan(pages, min_bytes)
    response = F.col("keeper").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit(""))
    body = F.when(response, F.concat(http, "payload")).otherwise(http)
    head = F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Refers-To", F.when(~response, record_id(F.col("keeper")))),
        line("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Payload-SHA256", F.col("sha256")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    record = F.concat(head, F.lit(END), body).alias("value")
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    low = -1
    for high, records in (*CLASSES, (None, 1)):
        if low < longest:
            some = rows.where((F.col("n") > low) & (F.col("n") <= high)) if high else rows.where(F.col("n") > low)
            writer = some.select(record).write.mode("append").option("lineSep", END * 2).option("compression", "gzip")
            writer.option("maxRecordsPerFile", records).text(path)
            low = high


@dataclass
class Record:
    head: bytes
    fields: dict[str, str]
    payload: bytes | None


def parse(archive: BinaryIO) -> Iterator[Record]:
    """The records of an archive, one at a time, read by their Content-Length. Payload digests are verified."""
    at = 0
    while first := archive.readline():
        if not re.fullmatch(rb"WARC/1\.\d\r\n", first):
            raise ValueError(f"no WARC record at byte {at}")
        head = [first]
        fields = {}
        while (line := archive.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"the head of the record at byte {at} does not end")
            head.append(line)
            name, _, value = line.decode().rstrip(END).partition(": ")
            fields[name] = value
        head.append(line)
        left = int(fields["Content-Length"])
        while left > 0:  # the HTTP head
            line = archive.readline(left)
            head.append(line)
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        body = archive.read(left)
        if len(body) != left or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        payload = None
        if fields["WARC-Type"] == "response":
            payload = body
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["WARC-Payload-Digest"] != f"sha1:{sha1}" or fields["X-Payload-SHA256"] != hashlib.sha256(payload).hexdigest():
                raise ValueError(f"the payload of the record at byte {at} does not have its digest")
        exact = b"".join(head)
        yield Record(exact, fields, payload)
        at += len(exact) + len(body) + 4


RECORD = "page_id long, record_type string, payload_digest string, sha256 string, head binary, payload binary"


def read(spark, path: str) -> DataFrame:
    """The records of the archives at ``path``; payload is null in a revisit. Digests are verified.

    A file is inflated and parsed as a stream, a few records at a time. A record
    without a page id has a null one. A folder without records gives no rows.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                rows, held = [], 0
                for r in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    page = r.fields.get("X-Page-Id")
                    digest = r.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((None if page is None else int(page), r.fields["WARC-Type"], digest, r.fields["X-Payload-SHA256"], r.head, r.payload))
                    held += len(r.head) + len(r.payload or b"")
                    if held > BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def store(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The content-addressed archive: (payloads, heads), written to the shared folder.

    payloads: sha256, page_id (of the response), payload_bytes, payload, each
    content once; of several responses with one content, that of the largest page
    id (null is the smallest). heads: page_id, record_type, payload_digest, sha256, and the record's
    exact bytes ahead of its payload, a row per record. No records, no rows.
    """
    answers = records.where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = answers.groupBy("sha256").agg(F.max(F.struct("page_id", "payload_bytes", "payload")).alias("r"))
    payloads = table(kept.select("sha256", "r.*"), "warc-payloads", compression="zstd")
    return payloads, table(records.select("page_id", "record_type", "payload_digest", "sha256", "head"), "warc-heads", compression="zstd")


def reconstruct(payloads: DataFrame, heads: DataFrame) -> DataFrame:
    """All records with their full payload: page_id, record_type, head, payload, and the response's page for a revisit.

    A row per head. A revisit whose response is not in the store keeps its head
    and digest, with a null payload.
    """
    kept = payloads.select("sha256", F.col("page_id").alias("response_id"), "payload_bytes", "payload")
    refers = F.when(F.col("record_type") == "revisit", F.col("response_id")).alias("refers_to")
    return heads.join(kept, "sha256", "left").select("page_id", "record_type", "head", "payload", "payload_bytes", "payload_digest", refers)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages``, read them into a content-addressed store, and join the records together again.

    A row per input row. Null and empty html are empty payloads; a long one has
    an archive of its own; of pages that tie for the largest page_id all are
    responses, as are those without an id if no copy has one. An empty table gives
    no rows. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    return reconstruct(*store(read(spark, path)))


def query(pages: DataFrame) -> DataFrame:
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
k as (select *, max(page_id) over (partition by b) keeper from p),
h as (
  select *, ('0x' || sha1(b)) hex, sha1(b) s from k)
select page_id, octet_length(b)::bigint payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     (list_sum(list_transform(range(0, 5), lambda t:
       (((strpos('0123456789abcdef', substr(s, (((j * 5 + t) // 4) + 1)::bigint, 1)) - 1) >> (3 - (j * 5 + t) % 4)::int) & 1) << (4 - t)::int)) + 1)::bigint, 1), '' order by j)
   from (select unnest(range(0, 32)) j)) payload_digest,
  case when keeper is null or page_id is not distinct from keeper then 'response' else 'revisit' end record_type,
  case when keeper is not null and page_id is distinct from keeper then keeper end refers_to
from h
"""
