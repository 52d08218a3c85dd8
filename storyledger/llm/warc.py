"""Web archives: write captures as WARC records, read archives, assemble transactions.

Each page becomes a request, a response (or a revisit of an equal payload) and a metadata record; the request
and the metadata name the response in ``WARC-Concurrent-To``. Archives are written with Spark's text sink, whose
record separator is the one that ends a WARC record, so they land in whatever store the path names. They
are read as binary files and cut by ``Content-Length``, so a payload may contain anything.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyledger.llm.shipping import ship

CRLF = "\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"  # the tables have no capture time; no function here reads a clock
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 6_000
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "header_digest string, payload_digest string, payload_bytes bigint, fields string"
)


def _record(kind: str, record_id: Column, headers: list[Column], content_type: str, block: Column, size: Column) -> Column:
    head = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {WARC_DATE}"), *headers, F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def records(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """The text of every record of ``pages`` as ``value``.

    Of pages with equal payloads of ``LEAST_REVISIT_BYTES`` or more, the one with the largest key is the response.
    Null payloads are empty, a null key is written as empty. Blanks and control characters of a URL are written
    as ``%20``; a null URL has no header. Rows with the same key and payload write the same record again.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html")})
    same = (
        rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest")
        .agg(F.max(F.col("key").cast("bigint")).cast("string").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    joined = rows.join(same, "digest", "left")

    def name(of: Column, suffix: str = "") -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(of, F.lit("")), F.lit(":"), F.col("digest"), F.lit(f"{suffix}>"))

    main = name(F.col("key"))
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    together = F.concat(F.lit("WARC-Concurrent-To: "), main)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    response = _record("response", main, [uri, digest], "application/http; msgtype=response", F.concat(http, F.col("html")), F.octet_length(http) + F.col("bytes"))
    refers = [uri, digest, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first"))), F.lit(f"WARC-Profile: {PROFILE}")]
    revisit = _record("revisit", main, refers, "application/http; msgtype=response", http, F.octet_length(http))
    asked = F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}")
    request = _record("request", name(F.col("key"), ":request"), [uri, together], "application/http; msgtype=request", asked, F.octet_length(asked))
    noted = F.concat(F.lit("pageId: "), F.coalesce("key", F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", name(F.col("key"), ":metadata"), [uri, together], "application/warc-fields", noted, F.octet_length(noted))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    return joined.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    """Archives of ``pages`` in ``folder``, ``RECORDS_PER_FILE`` records each at most."""
    writer = records(pages, key, url, html).write.option("lineSep", CRLF + CRLF).option("compression", compression)
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; junk between records is skipped."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = headers.get("content-length", "")
        if not size.isdigit():
            at = stop
            continue
        yield headers, data[stop + 4 : stop + 4 + int(size)]
        at = stop + 4 + int(size)


def parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """One row of ``RECORD``; the payload's size and digest are taken from its bytes where it is there."""
    kind = headers.get("warc-type", "")
    row = {
        "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "header_digest": headers.get("warc-payload-digest"), "payload_digest": None, "payload_bytes": None, "fields": None,
    }
    if with_payload:
        row["payload"] = None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row["payload_digest"], row["payload_bytes"] = hashlib.sha1(payload).hexdigest(), len(payload)
            if with_payload:
                row["payload"] = payload
        else:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            row["payload_bytes"] = int(length[1]) if length else None
            row["payload_digest"] = (row["header_digest"] or "").removeprefix("sha1:") or None
    elif kind == "metadata":
        row["fields"] = block.decode("utf-8", "replace")
    return row


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    """All records of the archives in ``folder``, plain or gzip (also one member a record), as ``RECORD`` rows."""
    ship(spark)
    kind = RECORD + (", payload binary" if with_payload else "")
    names = [part.strip().split()[0] for part in kind.split(",")]
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                content = data.as_py()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                held, size = [], 0
                for headers, block in split_records(content):
                    held.append(parsed(headers, block, with_payload))
                    size += len(block) if with_payload else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,gz,warc}").load(folder).select("content")
    return files.mapInArrow(rows, kind)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture``, ``main`` (response or revisit), ``request``, ``metadata``, counts.

    Requests and metadata join the record they are concurrent to; without one, or if it is not in the archives, they
    make a capture of their own with a null ``main``. Of several records of a kind the first by identifier is shown;
    the counts tell how many distinct ones there were. Records written twice count once.
    """
    whole = F.struct(*[F.col(c) for c in found.columns])
    main = F.col("type").isin("response", "revisit")
    capture = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    known = found.where(F.col("record_id").isNotNull())
    once = known.groupBy(capture.alias("capture"), "record_id").agg(F.max(whole).alias("record"))
    kind = F.col("record.type")

    def first(wanted: Column) -> Column:
        return F.min_by(F.when(wanted, F.col("record")), F.when(wanted, F.col("record_id")))

    return once.groupBy("capture").agg(
        first(kind.isin("response", "revisit")).alias("main"),
        first(kind == "request").alias("request"),
        first(kind == "metadata").alias("metadata"),
        F.count(F.when(kind == "request", 1)).alias("n_requests"),
        F.count(F.when(kind == "metadata", 1)).alias("n_metadata"),
    )


def page_key(record_id: Column) -> Column:
    """The page key inside a record identifier of ``records``; null if it was."""
    return F.regexp_extract(record_id, r"^<urn:page:([^:]*):", 1).try_cast("bigint")
