"""Web archives (WARC 1.1) without repeated payloads.

Which record keeps its payload is decided on headers alone, shuffled by payload digest: of equal
payloads the record with the smallest page_id is a ``response``, the others are ``revisit``
records that refer to it. The archives are written by Spark's text writer, whose line separator is
the end of a WARC record, so lost tasks are simply run again. They are read back with the record
lengths, and revisits are resolved by joining them to the responses that they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.session import scratch_path, write_table

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSpec:
    date: str = ""  # WARC-Date of all records; the time of the call if empty
    records_per_file: int = 20_000  # at most
    file_bytes: int = 128 << 20  # of a file before compression, at the mean length of a record


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of the UTF-8 bytes."""
    digits = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """One id per record: rows equal in all columns differ by ``copy``, counted from 1."""
    again = F.when(copy > 1, copy.cast("string"))
    text = F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit("-")), again)
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def write_archive(pages: DataFrame, path: str, spec: WarcSpec = WarcSpec()) -> None:
    """Write a record for each row of ``pages (page_id, url, html)`` to gzip files in ``path``."""
    date = spec.date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("digest", payload_digest(F.col("html")))
    heads = pages.groupBy("page_id", "url", "digest").agg(
        F.count("*").alias("copies"), F.max(F.octet_length("html").cast("long")).alias("bytes")
    )
    heads = write_table(heads, "heads")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    first = heads.groupBy("digest").agg(F.min(order).alias("first"))
    own = F.struct(F.col("page_id"), F.col("url"))
    decided = heads.join(first, "digest").select(
        F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("digest").alias("_digest"),
        own.eqNullSafe(F.struct("first.page_id", "first.url")).alias("response"),
        _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1)).alias("original"),
        F.coalesce("first.url", F.lit("")).alias("original_url"), "copies",
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("digest") == F.col("_digest"))
    rows = pages.join(decided, same).drop("_page", "_url", "_digest").withColumn("copy", F.lit(1))
    # of equal rows only one may keep the payload; they meet in the map tasks and are numbered
    several = F.col("copies") > 1
    names = [c for c in rows.columns if c not in ("html", "copy")]
    repeated = rows.filter(several).groupBy(*names).agg(F.first("html").alias("html"))
    repeated = repeated.withColumn("copy", F.explode(F.expr("sequence(1, CAST(copies AS INT))")))
    repeated = repeated.withColumn("response", F.col("response") & (F.col("copy") == 1))
    rows = rows.filter(~several).unionByName(repeated)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20]", ""), F.lit("\r\n"))

    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"),
    )
    body = F.when(F.col("response"), body).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce("url", F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(F.col("response"), F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit(_PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<"), F.col("original"), F.lit(">"))),
                line("WARC-Refers-To-Target-URI", F.col("original_url")),
            )
        ),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    mean = heads.agg(F.avg("bytes")).first()[0] or 0.0
    most = max(1, min(spec.records_per_file, int(spec.file_bytes // (mean + 1024))))  # with the headers
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", most).text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive file, one at a time."""
    stream = io.BytesIO(raw)
    if raw[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        headers = {}
        while (text := stream.readline()) not in (b"\r\n", b""):
            name, _, value = text.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse_records(content.as_buffer().to_pybytes()):
                page = headers["warc-page-id"]
                row = [headers["warc-record-id"].strip("<>"), int(page) if page else None, headers["warc-type"]]
                if row[2] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    row += [None, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()]
                else:
                    row += [headers["warc-refers-to"].strip("<>"), None, None]
                rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: its ids and type, and, for responses, length and digest of the payload."""
    schema = "record_id string, page_id long, record_type string, refers_to_id string, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record.

    A revisit record has the payload of the response it refers to, and its page_id in
    ``refers_to``. One whose response is not in the archives keeps nulls there.
    """
    responses = records.filter("record_type = 'response'")
    payloads = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = revisits.join(payloads, "refers_to_id", "left").select(*names)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).union(found)


def archive_and_read(pages: DataFrame, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, revisits resolved.

    Needs ``page_id, url, html``; other columns are ignored. A null html is an empty payload, and
    empty payloads are equal. Of equal payloads the smallest page_id is the response, a null
    page_id only if there is no other; of rows with that page_id, the one with the smallest url.
    Of rows equal to the response in all three columns, one is the response and the others revisit it. White space and control
    characters in a url are left out of the header. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, spec)
    return resolve_revisits(write_table(read_archive(spark, path), "records"))
