"""WARC archives: writing captures, reading them back, assembling transactions.

Writing is DataFrame work: every page becomes a request, a response (or revisit)
and a metadata record; the two others name the response in WARC-Concurrent-To.
Of captures with the same payload, the one with the largest page id is the
response and the others are revisits that name its record in WARC-Refers-To.
Spark's text writer puts the records into gzipped files with the record
separator as its line separator, in the shared folder, so that any executor can
read them. Pages are written in classes of payload size, each with as many
records a file (``RECORDS_PER_FILE`` at most) as keep a file near ``FILE_BYTES``
before compression; one page is never split, so a larger one is a file of its own.

Reading goes through Spark's binary file source and parses each file by
Content-Length. Assembly joins requests and metadata to their response through
the concurrent-to ids, and revisits to the response they refer to through its
record id, and gives one nested row per capture.

Defined cases: null html is an empty payload; a null url gives no target URI, and
control characters in urls are dropped; rows that share payload and page id are
the same capture and all responses when it is the largest id; a group of null ids
only has no owner, so all its rows are responses; an empty table gives an archive
without records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelane.llm.common import shared_path, staged, table

RECORDS_PER_FILE = 6_000
FILE_BYTES = 256 << 20
_SALTS = 16  # a response that many revisits name is dealt to so many tasks
REVISIT_FROM_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Hexadecimal SHA-1 in upper-case base32: each ten hex digits are forty bits, eight letters."""
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("long")
        for letter in range(8):
            at = F.shiftright(bits, 35 - 5 * letter).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(_BASE32), at + 1, F.lit(1)))
    return F.concat(*letters)


def _record(kind: str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """Text of a record without the separator that follows it; null headers are left out."""
    lines = [F.lit(f"WARC/1.1{_CRLF}WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}"), *headers,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(2 * _CRLF), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _urn(kind: str, uid: str = "uid", page_id: str = "page_id") -> Column:
    digits = F.md5(F.concat_ws("|", F.lit(kind), F.col(uid).cast("string"), F.col(page_id).cast("string"), F.col("digest")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def capture_records(pages: DataFrame) -> DataFrame:
    """The records of all pages: html of the page and value, the record's text."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"),
                            F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x1F\x7F]", "").alias("url"), html.alias("html"),
                            F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("digest"),
                            F.monotonically_increasing_id().alias("uid"))
    owners = (captures.filter(F.col("bytes") >= REVISIT_FROM_BYTES).groupBy(F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"))
              .agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid"))).alias("owner"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 AND owner IS NOT NULL")
              .select("o_digest", "o_bytes", F.col("owner.page_id").alias("owner"), F.col("owner.uid").alias("owner_uid")))
    decided = captures.join(owners, (F.col("digest") == F.col("o_digest")) & (F.col("bytes") == F.col("o_bytes")), "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    decided = decided.select("*", revisit.alias("revisit"), _urn("response").alias("id"))

    uri = _header("WARC-Target-URI", F.col("url"))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    beside = _header("WARC-Concurrent-To", F.col("id"))
    http = F.lit("Content-Type: application/http; msgtype=response")
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1), F.lit(""))
    response = _record("response", F.col("id"), [uri, digest, http], F.concat(F.lit(_HTTP), F.col("html")))
    revisited = _record("revisit", F.col("id"), [uri, digest, F.lit(f"WARC-Profile: {_PROFILE}"),
                                                 _header("WARC-Refers-To", _urn("response", "owner_uid", "owner")), http], F.lit(_HTTP))
    request = _record("request", _urn("request"), [uri, beside, F.lit("Content-Type: application/http; msgtype=request")],
                      F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(2 * _CRLF)))
    facts = F.concat_ws(_CRLF, _header("pageId", F.col("page_id")), _header("payloadBytes", F.col("bytes")))
    metadata = _record("metadata", _urn("metadata"), [uri, beside, F.lit("Content-Type: application/warc-fields")],
                       F.concat(facts, F.lit(_CRLF)))
    records = F.array(F.when(F.col("revisit"), revisited).otherwise(response), request, metadata)
    return decided.select("html", F.explode(records).alias("value"))


def _size_class(octets: Column, smallest: int) -> Column:
    """0 for records up to ``smallest`` bytes, one more for each factor of 16 beyond."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(octets, F.lit(1)) / F.lit(float(smallest))) / F.log(F.lit(16.0)))).cast("int")


def write_warc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped archives: one per task and class of sizes, more if it has many records."""
    records, smallest = capture_records(pages), max(1, file_bytes // records_per_file)
    classes = pages.agg(F.max(_size_class(F.octet_length(F.col("html").cast("string")), smallest))).first()[0] or 0
    for at in range(classes + 1):  # nearly always one; pages of up to 2 GB make a few
        chosen = records.filter(_size_class(F.octet_length("html"), smallest) == at) if classes else records
        (chosen.select("value").write.mode("append").option("lineSep", 2 * _CRLF).option("compression", "gzip")
         .option("maxRecordsPerFile", max(1, records_per_file // 16 ** at)).text(path))


_RECORD_FIELDS = [("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
                  ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("page_id", pa.int64()),
                  ("payload_bytes", pa.int64()), ("http", pa.string()), ("payload", pa.binary())]
_RECORD_DDL = ("record_id string, type string, concurrent_to string, target_uri string, date string, payload_digest string, "
               "refers_to string, page_id long, payload_bytes long, http string, payload binary")


def records_of(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of every record of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _parsed(headers: dict, block: bytes, with_payload: bool) -> tuple:
    kind = headers["warc-type"]
    digest = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    fields, payload, http = {}, None, None
    if kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode("utf-8").split(_CRLF) if ": " in line)
    elif kind in ("request", "response", "revisit"):
        head, _, payload = block.partition(2 * _CRLF.encode())
        http = head.decode("utf-8")
    size = _number(fields.get("payloadBytes"))
    if kind == "response":
        size = len(payload)
        if digest != (found := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
            raise ValueError(f"{headers['warc-record-id']}: payload digest {found}, header {digest}")
    return (headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
            digest, headers.get("warc-refers-to"), _number(fields.get("pageId")), size, http,
            payload if with_payload and kind == "response" else None)


def _parse_archives(with_payload: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                    for headers, block in records_of(stream):
                        rows.append(_parsed(headers, block, with_payload))
                        held += len(block) if with_payload else 500
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)
    return run


def _batch(rows):
    columns = list(zip(*rows)) if rows else [()] * len(_RECORD_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _RECORD_FIELDS)], schema=pa.schema(_RECORD_FIELDS))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_archives(with_payload), _RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, request, response, metadata and refers_to (page id of the response that a revisit names)."""
    records = staged(records, "warc-records")
    response = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"), F.struct("record_id", "type", "target_uri", "date", "payload_digest", "refers_to",
                                                 "payload_bytes", "http", "payload").alias("response"))
    request = records.filter("type = 'request'").select(
        F.col("concurrent_to").alias("to_request"), F.struct("record_id", "target_uri", "date", "http").alias("request"))
    metadata = records.filter("type = 'metadata'").select(
        F.col("concurrent_to").alias("to_metadata"), F.struct("record_id", "date", "page_id", "payload_bytes").alias("metadata"))
    # Revisits to the page of the record they name: its metadata record knows it.
    revisits = records.filter("type = 'revisit'").select(F.col("record_id").alias("of"), "refers_to",
                                                         F.pmod(F.xxhash64("record_id"), F.lit(_SALTS)).alias("salt"))
    named = records.filter("type = 'metadata'").join(revisits.select(F.col("refers_to").alias("concurrent_to")).distinct(), "concurrent_to",
                                                     "left_semi")
    named = named.select(F.col("concurrent_to").alias("refers_to"), F.col("page_id").alias("named"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
    referred = revisits.join(named, ["refers_to", "salt"]).select("of", "named")
    return (response.join(request, F.col("id") == F.col("to_request"), "left")
            .join(metadata, F.col("id") == F.col("to_metadata"), "left")
            .join(referred, F.col("id") == F.col("of"), "left")
            .select(F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata", F.col("named").alias("refers_to")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_warc(spark, path, with_payload=False))
    return captures.select("page_id", F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
                           F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
                           "refers_to")


_LETTERS = " || ".join(f"substr('{_BASE32}', (((('0x' || substr(hex, {10 * part + 1}, 10))::BIGINT >> {35 - 5 * letter}) & 31) + 1)::INT, 1)"
                       for part in range(4) for letter in range(8))
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS owner FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o
"""
