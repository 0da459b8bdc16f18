"""WARC archives: writing captures, reading them back, and assembling each capture's records into one row.

Every capture is three records: a request, a response (or a revisit of an earlier equal payload) and a metadata record; request and
metadata name the response in ``WARC-Concurrent-To``. Records are composed with built-in expressions and written by Spark's text writer,
whose line separator is the blank line that closes a record, so archives land in any store Spark can write. Reading walks each file by
``Content-Length``, so payloads may hold anything. Assembly joins the three kinds by concurrent-to identifiers, which are unique, so no key
is hot; the join of a page with the first page of its digest may be skewed and is left to adaptive execution, which splits it.

Defined results: a null html is an empty payload; a null url gives a record without a target; a repeated row is a capture of its own, and all
rows with the smallest page id of a digest are responses; a null page id is larger than any other; an empty table writes an empty archive;
other columns are not read.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.session import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records an archive file holds at most.
RECORDS_PER_FILE = 12_000


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        for place in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, place).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One row per page: payload, its size and digest, whether it is a response or a revisit, and the page a revisit refers to."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", sha1_base32(F.col("html").cast("binary")))
    # the first of a digest is found from keys alone; the join with it shuffles payloads once
    seen = own.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest")
    firsts = seen.agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    joined = own.join(firsts, "payload_digest", "left")
    revisit = F.col("first_page").isNotNull() & ((F.col("page_id") != F.col("first_page")) | F.col("page_id").isNull())
    revisit = revisit & (F.col("payload_bytes") >= min_revisit_bytes)
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def records(caps: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of each record, without the blank line that closes it; three rows a capture."""

    def urn(kind: str) -> Column:
        h = F.md5(F.concat(F.col("_key"), F.lit("/" + kind)))
        parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    def record(kind: Column, identifier: Column, headers: list[Column], block: Column) -> Column:
        lines = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), identifier),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x1f]", "")),  # dropped where null
            *headers,
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)

    keyed = caps.withColumn("_key", F.concat_ws("/", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    response = urn("response")
    path = F.regexp_replace(F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), "[\\x00-\\x20]", "")
    host = F.regexp_replace(F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")), "[\\x00-\\x20]", "")
    get = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    is_revisit = F.col("record_type") == "revisit"
    fields = F.concat(
        F.concat_ws(
            CRLF,
            F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
            F.concat(F.lit("refers-to-page-id: "), F.col("refers_to").cast("string")),
        ),
        F.lit(CRLF),
    )
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response)
    return keyed.select(
        F.explode(
            F.array(
                record(F.lit("request"), urn("request"), [concurrent, F.lit("Content-Type: application/http; msgtype=request")], get),
                record(
                    F.col("record_type"),
                    response,
                    [
                        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
                        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                        F.lit("Content-Type: application/http; msgtype=response"),
                    ],
                    F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html"))),
                ),
                record(F.lit("metadata"), urn("metadata"), [concurrent, F.lit("Content-Type: application/warc-fields")], fields),
            )
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzip-compressed archives of all pages below ``path``."""
    out = records(captures(pages, min_revisit_bytes)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    out.option("maxRecordsPerFile", per_file).text(path)


RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, target_uri string, payload_digest string, payload_bytes long, "
    "fields map<string,string>, payload binary"
)


def _headers(stream: io.BufferedIOBase, end: bytes = b"\r\n") -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (end, b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _parse(stream: io.BufferedIOBase, payloads: bool) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines after a record
        head = _headers(stream)
        block = stream.read(int(head.get("content-length", 0)))
        kind = head.get("warc-type")
        fields: dict[str, str] = {}
        payload, size = None, None
        if kind in ("response", "revisit"):
            http = io.BytesIO(block)
            http.readline()
            inner = _headers(http)
            size = int(inner.get("content-length", 0))
            payload = http.read() if payloads and kind == "response" else None
        elif kind == "metadata":
            fields = _headers(io.BytesIO(block))
        digest = head.get("warc-payload-digest")
        yield (
            head.get("warc-record-id"),
            kind,
            head.get("warc-concurrent-to"),
            head.get("warc-target-uri"),
            digest.rpartition(":")[2] if digest else None,
            size,
            fields,
            payload,
        )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``; a revisit has the digest and size of its payload, not the payload."""
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "target_uri", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[6] = [list(x.items()) for x in columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for files in batches:
            for content in files.column("content"):
                rows, size = [], 0
                with gzip.open(io.BytesIO(content.as_buffer()), "rb") as stream:
                    for row in _parse(io.BufferedReader(stream), payloads):
                        rows.append(row)
                        size += len(row[7] or b"") + 500
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined through concurrent-to identifiers."""
    main = found.where("record_type in ('response', 'revisit')").select(
        "record_id", F.struct("record_type", "target_uri", "payload_digest", "payload_bytes", "payload").alias("response")
    )
    request = found.where("record_type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("request_id"), "target_uri").alias("request"))
    metadata = found.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("metadata_id"), "fields").alias("metadata"))
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write archives of all pages into the shared folder, read them back, and assemble the captures."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return assemble(read_records(spark, path, payloads))
