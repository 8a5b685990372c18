"""WARC archives with revisits, segments and chunked transfer framing (operator 10).

Writing: one record a page. Among records with equal payloads of at least
``REVISIT_BYTES``, the one with the largest page id is a response and the others
are revisits of it. A response's block is an HTTP message whose body is in
chunked transfer framing; a block longer than ``SEGMENT_BYTES`` is cut into a
first segment and continuation records, which may lie in any file. Archives are
written by Spark's text writer with the record end CRLF CRLF as line separator,
so that only committed task output counts and any file system Spark knows will do.

Reading: files are parsed record by record by Content-Length; segments are
grouped by origin identifier, ordered by segment number, checked against the
total length, and the HTTP body is unframed and checked against its digest.

Record ids number the rows of the table as it is read. Of foreign archives, ids
that aren't of that form give no page id.

Cases: a null html is an empty payload; a null page id stays null (its records
can revisit, and are responses only where no page of the payload has an id);
rows that repeat a response's page id and payload are responses too; pages of
any length are cut into segments; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, shared_dir, table

REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_A_FILE = 2000
#: Pages have no date of their own, and reruns agree.
DATE = "1970-01-01T00:00:00Z"
BROADCAST_ROWS = 100_000
END = "\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";", 1)[0], 16)
        if not size:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + size])
        if len(out[-1]) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than its length")
        at = end + 4 + size


def header(kind: str, record: str, length: int, *more: tuple[str, object]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", *[f"{k}: {v}" for k, v in more], f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record_id(page: int | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def records(page, row: int, url: str | None, payload: bytes, refers, refers_row, segment: int = SEGMENT_BYTES, date: str = DATE) -> Iterator[bytes]:
    """The records of a page, without their ends. ``row`` tells rows of one page apart."""
    name = record_id(page, row)
    dated = ("WARC-Date", date)
    digest = ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")
    where = ("WARC-Target-URI", "".join((url or "about:blank").split()) or "about:blank")
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield header("revisit", name, len(block), dated, where, digest, ("WARC-Refers-To", f"<{record_id(refers, refers_row)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    typed = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield header("response", name, len(block), dated, where, digest, typed) + block
        return
    last = (len(block) - 1) // segment
    for k in range(last + 1):
        part = block[k * segment : (k + 1) * segment]
        number = ("WARC-Segment-Number", k + 1)
        if k:
            total = [("WARC-Segment-Total-Length", len(block))] * (k == last)
            yield header("continuation", f"{name}:{k + 1}", len(part), dated, where, ("WARC-Segment-Origin-ID", f"<{name}>"), number, *total) + part
        else:
            yield header("response", name, len(part), dated, where, digest, number, typed) + part


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as gzip WARC files under ``path``."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    p = p.withColumn("digest", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", (-F.col("row")).alias("row"))).alias("r"), F.count("*").alias("n")).select("digest", "n", F.col("r.page_id").alias("ref"), (-F.col("r.row")).alias("ref_row")).where("n > 1 and ref is not null")
    # the reversed digest as key: both sides are dealt anew, and AQE may split a payload of very many pages
    refs = bounded_broadcast(groups.select(F.reverse("digest").alias("k"), "ref", "ref_row"), BROADCAST_ROWS)
    p = p.withColumn("k", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.reverse("digest"))).join(refs, "k", "left")
    p = p.select("page_id", "row", "url", "payload", F.when(F.coalesce(F.col("page_id") != F.col("ref"), F.col("ref").isNotNull()), F.col("ref")).alias("refers"), "ref_row")
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield table(schema, [x for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in records(*row)])

    out = p.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        block = data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} isn't as long as it says")
        at += 4
        yield head, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(length the message gives or has, body) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
        return len(body), body
    return int(fields.get(b"content-length", len(body))), body


RECORD = "origin string, segment int, total long, record_type string, payload_digest string, refers string, payload_bytes long, block binary"


def read(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each page of the archives under ``path``."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])

    def hexed(digest: str | None) -> str | None:
        """A SHA-1 digest in hex; archives also write it in base 32."""
        digest = (digest or "").split(":", 1)[-1]
        return (base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()) or None

    def bare(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def checked(block: bytes, digest: str, kind: str) -> tuple[int, bytes]:
        size, body = payload_of(block)
        if kind == "response" and digest and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError("payload digest differs")
        return size, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = []
                for head, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, own = head["warc-type"], bare(head["warc-record-id"])
                    digest = hexed(head.get("warc-payload-digest"))
                    number = int(head.get("warc-segment-number", 0))
                    total = head.get("warc-segment-total-length")
                    size = None
                    if not number:
                        size, body = checked(block, digest, kind)
                        block = body if keep_payload else None
                    rows.append((bare(head.get("warc-segment-origin-id")) or own, number, int(total) if total else None, kind, digest, bare(head.get("warc-refers-to")), size, block))
                    if len(rows) == 256:
                        yield table(schema, *map(list, zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield table(schema, *map(list, zip(*rows, strict=True)))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = pa.schema([("origin", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    size, block = r["payload_bytes"], r["block"]
                    if size is None:
                        parts = r["parts"]
                        block = b"".join(p["block"] for p in parts)
                        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != r["total"]:
                            raise ValueError(f"segments of {r['origin']} don't make up the whole")
                        size, block = checked(block, r["payload_digest"], r["record_type"])
                    rows.append((r["origin"], size, r["payload_digest"], r["record_type"], r["refers"], block if keep_payload else None))
                yield table(final, *map(list, zip(*rows, strict=True)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path).select("content")
    r = files.mapInArrow(run, RECORD)
    first = lambda c: F.max(F.when(F.col("segment") <= 1, F.col(c))).alias(c)
    parts = F.array_sort(F.collect_list(F.when(F.col("segment") > 0, F.struct("segment", "block")))).alias("parts")
    whole = F.max(F.when(F.col("segment") == 0, F.col("block"))).alias("block")
    r = r.groupBy("origin").agg(first("record_type"), first("payload_digest"), first("refers"), first("payload_bytes"), F.max("total").alias("total"), whole, parts)
    r = r.mapInArrow(assembled, "origin string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary")
    page = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).try_cast("long")
    return r.select(page("origin").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers").alias("refers_to"), *["payload"] * keep_payload)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/warc-{uuid.uuid4().hex}"
    write(pages, path, **columns)
    return read(spark, path)
