"""WARC archives: writing captures as transactions, reading records, and assembling the transactions again.

A capture is three records: the response (or a revisit, where a capture with the same payload holds it), the
request and the metadata; the last two name the first in WARC-Concurrent-To. Archives are written by Spark's text
sink, whose line separator is the end mark of a record, so that executors need no file access of their own, and
are read as binary files whose records are framed by Content-Length alone.

Assembly joins records by their identifiers: the request may name the response or the response the request, and
metadata may name either. One nested row per capture results.

Which capture holds a payload is an aggregation over payload digests (partial sums before the shuffle, so that a
payload that a third of all pages share is no hot group) joined back on the digest; only identifiers take part in
this, never payloads.

Records read back carry the length and the base32 SHA-1 of the payload that was read.

Defined results: a null html is an empty payload; a null url gives records without WARC-Target-URI; line breaks in a
url are percent-encoded; repeated rows of one page_id are captures of their own, and of these one (with the greatest
digest of page_id, url and payload) is referred to; rows with equal page_id and payload are all responses; a null page_id is no
smaller than any; captures without request or metadata have null there; an empty table gives no archive and no rows. Columns besides page_id, url and html take no part.
Of an archive that is truncated or malformed, all records before the fault are read, and one row with error set, all
else null, tells the file and the fault; it belongs to no capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import saved, scratch

END = "\r\n\r\n"
#: Bytes of an archive before compression, about.
FILE_BYTES = 32_000_000
RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, content_type string, head string, payload_bytes long, payload_sha1 string, payload binary, error string"
BATCH_BYTES = 8_000_000
#: Compressed bytes that are looked at together; decompressed bytes beyond which those that were read are dropped.
STEP, DROP = 16_384, 1_000_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str | None, nth: int) -> str:
    return f"<{uuid.UUID(bytes=hashlib.md5(f'{kind} {key} {nth}'.encode()).digest(), version=4).urn}>"


def record(kind: str, rid: str, uri: str | None, kind_of_content: str, block: str, date: str, **more: str | None) -> str:
    """A record without its end mark."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": kind_of_content, "Content-Length": str(len(block.encode()))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n" + block


def capture_records(page_id: int | None, key: str, nth: int, url: str | None, html: str | None, refers: str | None, date: str) -> list[str]:
    """The three records of a capture. key and nth tell captures apart; refers is the key of the first that holds the
    payload."""
    html, payload = html or "", (html or "").encode()
    uri = None if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    rid, digest = record_id("response", key, nth), f"sha1:{sha1_base32(payload)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    if refers is None:
        first = record("response", rid, uri, "application/http;msgtype=response", http + html, date, WARC_Payload_Digest=digest)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        first = record("revisit", rid, uri, "application/http;msgtype=response", http, date, WARC_Payload_Digest=digest, WARC_Profile=profile, WARC_Refers_To=record_id("response", refers, 1))
    path = re.sub(r"^[^/]*//[^/]*", "", uri or "").partition("#")[0] or "/"
    host = (re.match(r"[^/]*//([^/?#]*)", uri or "") or ["", ""])[1]
    request = record("request", record_id("request", key, nth), uri, "application/http;msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n", date, WARC_Concurrent_To=rid)
    about = "" if page_id is None else f"page-id: {page_id}\r\n"
    return [first, request, record("metadata", record_id("metadata", key, nth), uri, "application/warc-fields", about, date, WARC_Concurrent_To=rid)]


def with_first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, key (digest of all three), nth (among rows of one key) and refers: the key of the capture
    that holds the payload of a page (the largest page_id of equal payloads of at least min_bytes), null if itself.
    Payloads are shuffled once, by key; all else moves digests alone. Only rows equal in everything share a key."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", "url")))
    short = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "key", "digest")
    holders = short.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("last"), F.count("*").alias("n"))
    # Written first, as Spark splits hot keys only in joins of plain exchanges.
    holders = saved(holders.where("n > 1").select("digest", F.col("last.page_id").alias("of_page"), F.col("last.key").alias("refers")), "holders")
    others = short.join(holders, "digest").where(~F.col("of_page").eqNullSafe(F.col("page_id")))
    revisits = others.select("key", "refers").distinct()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("digest"))
    return rows.withColumn("nth", nth).join(revisits, "key", "left").select("page_id", "url", "html", "key", "nth", "refers")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write the captures of all pages as gzipped archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch[c] for c in ("page_id", "key", "nth", "url", "html", "refers"))):
                out += (got := capture_records(*(x.as_py() for x in row), date))
                if (size := size + sum(map(len, got))) >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    n, size = pages.select(F.count("*"), F.sum(F.octet_length("html"))).first()
    rows = 3 * max(1, int(file_bytes / (1500 + (size or 0) / max(n, 1))))
    records = with_first_copies(pages, min_bytes).mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(folder)


def fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


class Fault(ValueError):
    """What is wrong with an archive."""


def plain_parts(data: memoryview) -> Iterator[memoryview | bytes]:
    """The bytes of an archive in parts, decompressed if it is gzipped (as a whole or by records)."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (data[i : i + DROP] for i in range(0, len(data), DROP))
        return
    at, d = 0, None
    while at < len(data):
        part = data[at : at + STEP]
        if d is None:
            if part[0] == 0:  # padding between members
                at += 1
                continue
            d = zlib.decompressobj(31)
        try:
            yield d.decompress(part)
        except zlib.error as e:
            raise Fault(f"bad compression near byte {at}: {e}") from None
        at += len(part) - len(d.unused_data)
        if d.eof:
            d = None
    if d is not None:
        raise Fault("the last compressed member is cut off")


class Reader:
    """Bytes that come in parts, of which only those not yet read are held."""

    def __init__(self, parts: Iterator[memoryview | bytes]) -> None:
        self.parts, self.held, self.at, self.fault = parts, bytearray(), 0, None

    def more(self) -> bool:
        if self.at > DROP:
            del self.held[: self.at]
            self.at = 0
        try:
            part = next(self.parts, None)
        except Fault as e:
            part, self.fault = None, e
        if part is not None:
            self.held += part
        return part is not None

    def ended(self) -> bool:
        """Whether nothing but line ends is left; skips them."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                return False
            if not self.more():
                return True

    def upto(self, mark: bytes) -> bytes:
        look = self.at
        while (k := self.held.find(mark, look)) < 0:
            back = len(self.held) - self.at
            if not self.more():
                raise self.fault or Fault("a record's head is cut off")
            look = self.at + max(0, back - len(mark) + 1)
        out = bytes(memoryview(self.held)[self.at : k])
        self.at = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise self.fault or Fault("a record's block is cut off")
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at += n
        return out


def parse(data: bytes) -> Iterator[tuple]:
    """Records of an archive, framed by Content-Length, in one pass. Raises Fault after the last whole record."""
    reader = Reader(plain_parts(memoryview(data)))
    while not reader.ended():
        top = reader.upto(b"\r\n\r\n")
        if not top.startswith(b"WARC/"):
            raise Fault("no record where one should begin")
        h = fields(top)
        if not (size := h.get("content-length", "")).isascii() or not size.isdigit():
            raise Fault(f"a record with the length {size!r}")
        block, head, payload = reader.take(int(size)), None, None
        kind = h.get("warc-type")
        if "application/http" in h.get("content-type", ""):
            text, blank, rest = block.partition(b"\r\n\r\n")
            head = text.decode("utf-8", "replace")
            payload = rest if kind == "response" else None
        elif kind == "metadata":
            head = block.decode("utf-8", "replace")
        else:
            payload = block
        yield h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("content-type"), head, None if payload is None else len(payload), None if payload is None else sha1_base32(payload), payload, None
    if reader.fault:
        raise reader.fault


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives of a folder, and a row with error for each that isn't whole. A file's compressed bytes
    are held by the task that reads it, its records in batches."""
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 12, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, size = [], 0
                try:
                    for r in parse(memoryview(content.as_buffer())):
                        rows.append(r)
                        if (size := size + 500 + len(r[10] or b"")) >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                except Fault as e:
                    rows.append((None,) * 11 + (f"{path}: {e}",))
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, refers_to, response, request, metadata."""
    captures = records.where(F.col("record_type").isin("response", "revisit", "resource"))
    others = records.where(F.col("record_type").isin("request", "metadata"))
    ids = captures.select("record_id", "concurrent_to")
    links = ids.select(F.col("record_id").alias("member"), F.col("record_id").alias("capture_id")).union(ids.where("concurrent_to is not null").select("concurrent_to", "record_id"))
    links = links.dropDuplicates(["member"])
    own = others.select("record_id", "record_type", "concurrent_to", "head", F.explode(F.array_distinct(F.array_compact(F.array("concurrent_to", "record_id")))).alias("member"))
    first = own.join(links, "member", "left").groupBy("record_id", "record_type", "concurrent_to", "head").agg(F.min("capture_id").alias("capture_id"))
    # Metadata may name a request that names the capture.
    via = first.where("record_type = 'request' and capture_id is not null").select(F.col("record_id").alias("concurrent_to"), F.col("capture_id").alias("via_id")).dropDuplicates(["concurrent_to"])
    tied = first.join(via, "concurrent_to", "left").select("record_id", "record_type", "head", F.coalesce("capture_id", "via_id").alias("capture_id")).where("capture_id is not null")
    part = lambda kind: F.min(F.when(F.col("record_type") == kind, F.struct("record_id", "head"))).alias(kind)
    tied = tied.groupBy("capture_id").agg(part("request"), part("metadata"))
    response = F.struct("record_id", "record_type", "payload_digest", "content_type", "head", "payload_bytes", "payload_sha1", "payload").alias("response")
    return captures.select(F.col("record_id").alias("capture_id"), "target_uri", "refers_to", response).join(tied, "capture_id", "left")


def archive_captures(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages to archives in a folder (a new one in the shared folder), read and assemble them."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_archives(pages, folder, min_bytes)
    return transactions(saved(read_archives(spark, folder), "records"))


def digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to by page; a revisit has the payload of the
    response to which it refers."""
    short = captures.select(
        "capture_id",
        F.col("refers_to").alias("holder_id"),
        F.regexp_extract("metadata.head", r"(?:^|\n)page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.payload_sha1").alias("own_digest"),
    )
    short = saved(short, "captures")
    holders = short.where("record_type = 'response'").select(F.col("capture_id").alias("holder_id"), F.col("page_id").alias("of_page"), F.col("own_bytes").alias("of_bytes"), F.col("own_digest").alias("of_digest"))
    revisits = short.where("record_type = 'revisit'").join(holders, "holder_id", "left")
    plain = short.where("record_type <> 'revisit'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.union(revisits.select("page_id", "of_bytes", "of_digest", "record_type", "of_page"))
