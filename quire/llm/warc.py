"""WARC archives: a deduplicating writer and a salvage reader.

The writer is native: a record is text, and the text sink's line separator is the CR LF CR LF
that ends a record, so Spark's own committer writes plain ``WARC/1.1`` files to any file system.
Of equal payloads the one with the smallest id is the response, the others are revisits of it. Archives
are sized by bytes: payloads of up to ``small`` bytes go a thousand to a file at most, longer ones so many to a file that it
holds about ``target`` bytes and below ``most`` (or a single record).

The reader takes archives of plain records or of gzip members. A record or member that fails its
checks (version line, Content-Length, terminator, gzip CRC, payload digest) is not trusted:
the reader searches for the next member or version line, goes on from there, and reports the bytes
between as a ``gap`` row; ``quarantine`` writes these to a table and counts them. A member is inflated in blocks, and one of
more than ``INFLATED`` bytes is a gap too. A task holds one archive and one inflated member in memory, whatever
their payloads; there is no other bound on a payload's length. Time is linear in an archive's bytes while its
records are whole.

Null html is an empty payload; a null id is written as ``null`` and read back as null (such a row
is never the response that others refer to, and is a response itself if no other row of its
payload has an id); rows that repeat an id and a payload are each a response, and equal payloads tie to the smallest id; a null url is
``urn:none``; only the three named columns are read, so names of others can't clash; an empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, shared_dir, table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"(?<=\n)WARC/1\.[01]\r\n|\x1f\x8b\x08[\x00-\x1f]")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Base 32 of the SHA-1, twenty bits at a time."""
    h = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.upper(F.conv(F.substring(h, i * 5 + 1, 5), 16, 32)), 4, "0"), *_DIGITS) for i in range(8)))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for a response.

    Which rows are revisits is settled on ids and digests alone; the smallest id of each payload is
    aggregated map-side and joined back, so a payload that a third of the rows share is one row
    there, and its join partition one that AQE can split. The payloads then meet only the table of
    revisits, which Spark broadcasts where its size on disk is below the session's threshold.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    slim = materialize(rows.select("id", "payload_bytes", "payload_digest"))
    first = slim.groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes)).drop("n")
    later = slim.join(first, ["payload_digest", "payload_bytes"]).where((F.col("first_id") != F.col("id")) | F.col("id").isNull())
    later = materialize(later.select(F.col("id").alias("later_id"), F.col("payload_digest").alias("later_digest"), F.col("first_id").alias("refers_to")).where("refers_to is not null").distinct())
    return rows.join(later, F.col("id").eqNullSafe(F.col("later_id")) & (F.col("payload_digest") == F.col("later_digest")), "left").drop("later_id", "later_digest")


def record_text(date: str) -> Column:
    """The record without its terminator, from the columns of plan_records."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7f]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
    )


#: About what a record takes besides its payload.
HEAD = 1024


def _size_class(n: Column, bounds: list[int]) -> Column:
    return reduce(lambda a, b: a + (n > b).cast("int"), bounds, F.lit(0))


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", small: int = 1 << 16, target: int = 64 << 20, most: int = 1 << 30, **columns) -> None:
    """Archives of up to about ``target`` bytes: payloads go by size classes, each a factor of four wide, and a file takes as many records as the
    largest payload of its class allows. Payloads beyond ``small`` are one class, by their mean; a file of these is of ``most`` bytes at most, or one record."""
    plan = plan_records(pages, **columns)
    html = F.octet_length(F.coalesce(F.col(columns.get("html_col", "html")).cast("string"), F.lit("")))
    bounds = [b for b in (small // 16, small // 4, small) if b]
    found = pages.select(html.alias("n")).groupBy(_size_class(F.col("n"), bounds).alias("k")).agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.max("n").alias("longest")).collect()
    parts = [] if found else [(F.lit(False), 1)]  # no pages are an archive folder all the same
    for r in found:
        k = r["k"]
        records = target // (bounds[k] + HEAD) if k < len(bounds) else min(target // (r["total"] // r["n"]), most // (r["longest"] + HEAD))
        parts.append((_size_class(F.col("payload_bytes"), bounds) == k, max(1, records)))
    for which, records in parts:
        out = plan.where(which).select(record_text(date).alias("value"))
        out.write.mode("append").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and its end; ValueError names the check that fails."""
    if not _VERSION.match(data, at):
        raise ValueError("version")
    if (end := data.find(b"\r\n\r\n", at)) < 0:
        raise ValueError("header")
    head = _fields(data[at:end])
    if not re.fullmatch(r"[0-9]{1,18}", length := head.get("content-length", "")):
        raise ValueError("length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("terminator")
    block = data[start:stop]
    http, payload = {}, block
    if head.get("content-type", "").startswith("application/http"):
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(http_head)
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("digest")
    size = int(http["content-length"]) if revisit and http.get("content-length", "").isdigit() else len(payload)
    return {
        "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"),
        "payload_digest": digest or None, "refers_to": head.get("warc-refers-to"), "payload_bytes": size, "payload": payload,
    }, stop + 4


#: Bytes that go into a decompressor at once, and that a member may come to.
FEED, INFLATED = 1 << 16, 1 << 30


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that starts at ``at``, inflated, and its end; ValueError if it is damaged, cut or too large."""
    z, out, size = zlib.decompressobj(31), [], 0
    while not z.eof:
        if at >= len(data):
            raise ValueError("member")
        try:
            part = z.decompress(data[at : at + FEED], INFLATED + 1 - size)
        except zlib.error as e:
            raise ValueError("member") from e
        size += len(part)
        out.append(part)
        if size > INFLATED:
            raise ValueError("member size")
        at = min(len(data), at + FEED) - len(z.unused_data) - len(z.unconsumed_tail)
    return b"".join(out), at


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order. start and end are bytes of the archive."""
    at, n, gap, why = 0, len(data), None, ""
    while at < n:
        try:
            if data.startswith(b"\x1f\x8b", at):
                inner, end = _member(data, at)
                if gap is not None:
                    yield {"record_type": "gap", "start": gap, "end": at, "reason": why}
                    gap = None
                for r in salvage(inner) if inner[:2] != b"\x1f\x8b" else [{"record_type": "gap", "reason": "member"}]:
                    yield r | {"start": at, "end": end}
            else:
                r, end = _record(data, at)
                if gap is not None:
                    yield {"record_type": "gap", "start": gap, "end": at, "reason": why}
                    gap = None
                yield r | {"start": at, "end": end}
            at = end
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else n
    if gap is not None:
        yield {"record_type": "gap", "start": gap, "end": n, "reason": why}


_OUT = {"archive": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "start": pa.int64(), "end": pa.int64(), "reason": pa.string()}
_DDL = "archive string, record_type string, record_id string, url string, payload_digest string, refers_to string, payload_bytes long, payload binary, start long, end long, reason string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap (record_type ``gap``) of the archives below path."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for r in salvage(data.as_py() or b""):
                    rows.append(r | {"archive": name, "payload": r.get("payload") if payloads else None})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_OUT.items())))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_OUT.items())))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, _DDL)


def quarantine(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The records among rows of read_warc, and the number of gaps, which are written to a Parquet table below path."""
    rows.where("record_type = 'gap'").select("archive", "start", "end", "reason").write.parquet(path)
    return rows.where("record_type != 'gap'"), rows.sparkSession.read.schema("archive string, start long, end long, reason string").parquet(path).count()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raises if the archives that were just written have gaps, or lost or gained a record."""
    path, pages = shared_dir(spark), table(spark, sf_dir, "pages")
    write_warc(pages, path)
    rows = materialize(read_warc(spark, path, payloads=False))
    got, gaps = quarantine(rows, shared_dir(spark))
    if gaps or got.count() != (n := pages.count()):
        raise ValueError(f"{got.count()} records of {n} pages came back, with {gaps} gaps")
    page = lambda c: F.try_to_number(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("S9999999999999999999")).cast("long")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p
), e AS (
  SELECT page_id, payload_bytes, x,
    array_to_string(list_transform(range(0, 32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || x[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY x) AS first_id
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM e
"""
