r"""WARC archives: written as records, read back and joined into one row per capture.

Each page becomes a request, a response or revisit, and a metadata record; request and metadata
name the capture in WARC-Concurrent-To. Of pages with equal payloads of at least ``min_revisit``
bytes the one with the smallest page_id is a response, the others are revisits that refer to it
and carry no payload; shorter payloads are always responses.

Writing uses Spark's text writer with the record end ``\r\n\r\n`` as line end, so archives are plain
WARC/1.1 files, gzip-compressed, of at most ``PAGES_PER_FILE`` pages. Only pages whose digest occurs
more than once are looked up by digest; counts and minima combine before the shuffle.

Reading takes one file at a time, unpacks it record by record, finds records by Content-Length and checks every payload digest.
Records meet by capture id in one shuffle, in which a capture has its three records however popular
its payload is.

Rows: a null html is an empty payload; a null url is left out of the record and comes back null.
Every row is a capture, also rows that repeat page_id, url and html, and rows without page_id, which
have a null id and are never the response of others. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import new_path

END = "\r\n\r\n"
PAGES_PER_FILE = 2000
MIN_REVISIT = 100
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _capture_id(page: Column, row: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(":"), digest, F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header and block of a record; a field with a null value is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One text column: three WARC records for every row of ``pages(page_id, url, html)``."""
    html = F.coalesce("html", F.lit(""))
    # every row is a capture of its own, so its number among the scanned rows is part of its id
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    first = (rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("at"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", F.col("at.page_id").alias("first"), F.col("at.row").alias("first_row")))
    rows = rows.join(first, "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.lit(False))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = _capture_id(F.col("page_id"), F.col("row"), F.col("digest"))
    target = ("WARC-Target-URI", url)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http"))
    path = F.coalesce(F.parse_url(F.when(url.rlike(r"^[a-z]+://[^\s?#\\{}|^`<>\"%\[\]]+$"), url), F.lit("PATH")), F.lit("/"))
    request = _record("request", [("WARC-Record-ID", F.concat(F.lit("<urn:request:"), F.substring(own, 6, 200))), ("WARC-Concurrent-To", own), target, http],
                      F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1" + END)))
    response = _record("response", [("WARC-Record-ID", own), target, digest, http], F.concat(F.lit(HTTP_OK), F.col("html")))
    revisit = _record("revisit", [("WARC-Record-ID", own), target, digest, http, ("WARC-Profile", F.lit(_PROFILE)),
                                  ("WARC-Refers-To", _capture_id(F.col("first"), F.col("first_row"), F.col("digest")))], F.lit(HTTP_OK))
    metadata = _record("metadata", [("WARC-Record-ID", F.concat(F.lit("<urn:metadata:"), F.substring(own, 6, 200))), ("WARC-Concurrent-To", own), target,
                                    ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("size").cast("string")))
    return rows.select(F.concat(request, F.lit(END), F.when(again, revisit).otherwise(response), F.lit(END), metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    (records(pages, min_revisit).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", PAGES_PER_FILE).text(path))


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record of an archive, one after the other."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:80]!r}")
        head = b""
        while (line := stream.readline()) not in (b"\r\n", b""):
            head += line
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}
        yield fields, stream.read(int(fields["content-length"]))
        stream.read(4)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, id, capture, uri, refers_to, block fields, payload and its digest."""
    schema = ("type string, id string, capture string, uri string, refers_to string, digest string, "
              "payload binary, payload_bytes long, payload_sha256 string, block string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_py()
                packed = io.BytesIO(content)
                rows, held = [], 0
                for fields, block in parse(gzip.GzipFile(fileobj=packed) if content[:2] == b"\x1f\x8b" else packed):
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", ":").partition(":")[2]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    sha = hashlib.sha256(payload).hexdigest() if payload is not None else None
                    if sha is not None and sha != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((kind, fields["warc-record-id"], fields.get("warc-concurrent-to", fields["warc-record-id"]), fields.get("warc-target-uri"),
                                 fields.get("warc-refers-to"), digest, payload, None if payload is None else len(payload), sha,
                                 None if payload is not None else block.decode()))
                    held += len(block)
                    if len(rows) == 500 or held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    types = [pa.string()] * 6 + [pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = ["type", "id", "capture", "uri", "refers_to", "digest", "payload", "payload_bytes", "payload_sha256", "block"]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(read, schema)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture of the archives below ``path``, its records nested.

    capture, response(type, uri, refers_to, digest, payload, payload_bytes, payload_sha256),
    request(id, uri, block), metadata(id, block).
    """
    rows = read_records(spark, path)

    def of(name: str, kinds: tuple[str, ...], *fields: str) -> Column:
        return F.first(F.when(F.col("type").isin(*kinds), F.struct(*fields)), ignorenulls=True).alias(name)

    return rows.groupBy("capture").agg(
        of("response", ("response", "revisit"), "type", "uri", "refers_to", "digest", "payload", "payload_bytes", "payload_sha256"),
        of("request", ("request",), "id", "uri", "block"), of("metadata", ("metadata",), "id", "block"))


def page_number(capture: Column) -> Column:
    """The page_id in a capture id."""
    return F.nullif(F.regexp_extract(capture, r"^<urn:page:(-?\d+|none):", 1), F.lit("none")).cast("long")


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return their captures."""
    spark = pages.sparkSession
    path = new_path(spark, "warc-")
    write_archives(pages, path, min_revisit)
    return captures(spark, path)
