"""Web archives: records written as WARC files by Spark, read back and reassembled from their segments.

Writing: payloads go into HTTP responses with chunked transfer framing; a block over `segment` bytes continues in further
records that name their origin, their number and, in the last, the total length. Of equal payloads the largest page_id is
a response and the others are revisits that refer to it. Spark's text writer makes the files, a record to a line that ends
with the blank lines between records.

Reading: tasks walk through files by Content-Length, so nothing inside a payload can pass for a header. Whole records are
decoded at once; continuation records are grouped by origin, ordered by number and checked against the total length.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import saved
from mapweave.sources.shared import shared_folder

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 14


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> list[bytes]:
    """data in parts of about size bytes that end between characters; no part for no data."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, CHUNK)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at:at + size])
        if len(out[-1]) != size or body[at + size:at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        at += size + 2


def clean(value: str | None) -> str:
    """A header value: no line ends."""
    return (value or "").replace("\r", " ").replace("\n", " ").strip()


def record(kind: str, ident: str, uri: str, block: bytes, more: list[tuple[str, str]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), *more, ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v != "") + "\r\n" + block.decode("utf-8")


def _write(segment: int):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

    def run(batches):
        for b in batches:
            out = []
            for page, number, url, html, digest, first in zip(*(b.column(n).to_pylist() for n in ("page_id", "number", "url", "html", "digest", "first"))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                ident = f"urn:page:{'' if page is None else page}:{number}"
                more = [("WARC-Payload-Digest", f"sha1:{digest}")]
                if page == first:
                    parts = cuts(head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload), segment)
                    total = sum(map(len, parts))
                    for i, part in enumerate(parts, 1):
                        numbered = [("WARC-Segment-Number", str(i))] if len(parts) > 1 else []
                        if i > 1:
                            numbered += [("WARC-Segment-Origin-ID", f"<{ident}>")]
                        if i == len(parts) > 1:
                            numbered += [("WARC-Segment-Total-Length", str(total))]
                        out.append(record("response" if i == 1 else "continuation", ident if i == 1 else f"{ident}:{i}", clean(url), part, (more if i == 1 else []) + numbered))
                else:
                    more += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    out.append(record("revisit", ident, clean(url), head + b"Content-Length: %d\r\n\r\n" % len(payload), more))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return run


def _digests(batches):
    for b in batches:
        payloads = [(h or "").encode("utf-8", "surrogatepass") for h in b.column("html").to_pylist()]
        names = ["page_id", "number", "url", "html"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(map(len, payloads), pa.int64()), pa.array(map(digest_of, payloads), pa.string())], names=names + ["size", "digest"])


def write(pages: DataFrame, path: str, least: int = 0, segment: int = 1 << 20, records_per_file: int = 4096, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row of pages to gzipped WARC files under path.

    Of rows with equal payloads of at least `least` bytes those with the largest page_id are responses, the rest revisits.
    A null html is an empty payload, a null url has no target; a row with a null page_id is a revisit unless all its equals
    have none. Rows that repeat a page_id have records of their own. A file holds at most records_per_file * segment bytes.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("number"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    told = rows.mapInArrow(_digests, "page_id long, number long, url string, html string, size long, digest string")
    largest = told.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # only payloads that occur twice are looked up; others are their own first
    repeated = saved(largest.where("n > 1").select("digest", "first"), "repeated")
    rows = told.join(repeated.withColumn("known", F.lit(True)), "digest", "left")
    rows = rows.withColumn("first", F.when(F.col("known"), F.col("first")).otherwise(F.col("page_id")))
    lines = rows.mapInArrow(_write(segment), "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Stream:
    """Bytes of a gzipped or plain file, unpacked as they are read."""

    def __init__(self, data: bytes) -> None:
        self.source, self.packed, self.left = io.BytesIO(data), data[:2] == b"\x1f\x8b", b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        data = self.unpack.unused_data if self.packed and self.unpack.eof and self.unpack.unused_data else self.source.read(1 << 18)
        if not data:
            return False
        if self.packed:
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            data = self.unpack.decompress(data)
        self.left += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.left.find(mark)) < 0:
            if not self.more():
                return None
        out, self.left = self.left[:at], self.left[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        while len(self.left) < n and self.more():
            pass
        if len(self.left) < n:
            raise ValueError("a record ends early")
        out, self.left = self.left[:n], self.left[n:]
        return out


def records(data: bytes):
    """(headers, block) of each record of a file; header names in lower case."""
    stream = Stream(data)
    while True:
        head = stream.until(CRLF + CRLF)
        if head is None or not head.strip():
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one is due: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, stream.take(int(headers["content-length"]))
        if stream.take(4) != CRLF + CRLF:
            raise ValueError("a record is not ended")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def number_in(ident: str | None) -> int | None:
    part = (ident or "").strip("<>").split(":")
    return int(part[2]) if len(part) > 2 and part[2] else None


def decoded(headers_id: str, kind: str, refers: str | None, digest: str, block: bytes) -> tuple:
    head, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if kind == "response":
        payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        if digest != digest_of(payload):
            raise ValueError(f"payload of {headers_id} does not match its digest")
        return number_in(headers_id), len(payload), digest, kind, None
    return number_in(headers_id), int(fields[b"content-length"]), digest, kind, number_in(refers)


PARSED = "origin string, part int, total long, kind string, refers string, digest string, block binary, " + RESULT


def _parse(batches):
    names = [x.split()[0] for x in PARSED.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for b in batches:
        for content in b.column("content"):
            rows, size = [], 0
            for h, block in records(content.as_py()):
                ident, digest = h["warc-record-id"].strip("<>"), h.get("warc-payload-digest", "").removeprefix("sha1:")
                if "warc-segment-number" in h:
                    part = int(h["warc-segment-number"])
                    origin = ident if part == 1 else h["warc-segment-origin-id"].strip("<>")
                    total = h.get("warc-segment-total-length")
                    rows.append((origin, part, None if total is None else int(total), h["warc-type"], None, digest, block, *[None] * 5))
                    size += len(block)
                else:
                    rows.append((None, None, None, None, None, None, None, *decoded(ident, h["warc-type"], h.get("warc-refers-to"), digest, block)))
                if len(rows) >= 2000 or size > 1 << 24:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def _reassemble(batches):
    for b in batches:
        rows = []
        for origin, parts in zip(b.column("origin").to_pylist(), b.column("parts").to_pylist()):
            block = b"".join(p["block"] for p in parts)
            if [p["part"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                raise ValueError(f"segments of {origin} are not whole")
            rows.append(decoded(origin, "response", None, parts[0]["digest"], block))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], names=NAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record under path, continuations joined to their origin."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = saved(files.mapInArrow(_parse, PARSED), "records")
    whole = parsed.where("origin is null").select(*NAMES)
    # a group is one record, as large as the page that it was written from
    parts = parsed.where("origin is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("part", "total", "digest", "block"))).alias("parts"))
    return whole.union(parts.mapInArrow(_reassemble, RESULT))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back. An empty table writes no record and gives no rows."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    write(pages, path, **options)
    return read(pages.sparkSession, path)
