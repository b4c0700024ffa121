"""Legacy ARC archives to WARC, and both formats read and written by Spark.

An ARC file begins with a version block, whose lines name the version and the fields of the header line before each record; version 1 has
five fields, version 2 has ten. The last field declares the record's length, and nothing else bounds a record. The converter reads header
lines by the file's own version, takes the declared lengths, and synthesises what WARC has and ARC lacks: a record id (a name-based UUID of
target, date, digest, file and position in it, so no two records share one), an ISO timestamp, a content type, payload and block digests,
and whether a record is a response or revisits an equal payload.

Archives are written by Spark's text writer, compressed, in the folder that driver and executors share. Its rows are sections of about
``BATCH_BYTES``, each with a version block or a warcinfo record of its own, and a file ends after ``ARCHIVE_BYTES`` of them. So the binary file
source, whose rows are files, never meets a large one; only a single record may be larger, and is held in memory as it is in its row. A
file is one gzip stream, named by that writer. Which record of equal payloads is the response is decided over digests alone; then the
payloads are joined to that once.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of records given on at a time, and of a file before it is compressed.
BATCH_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 20
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArchiveError(ValueError):
    """An archive whose header lines or lengths are broken."""


class Stream:
    """Bytes of a file, decompressed as they are asked for; plain and gzip files, with any number of gzip members."""

    def __init__(self, content: bytes):
        self.content, self.at, self.left = content, 0, bytearray()
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if not self.packed:
            self.left += part
            return True
        while part:
            self.left += self.inflater.decompress(part)
            part = self.inflater.unused_data
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the file."""
        start = 0
        while (i := self.left.find(b"\n", start)) < 0:
            start = len(self.left)
            if not self._more():
                if not self.left:
                    return None
                i = len(self.left)
                break
        out = bytes(self.left[:i]).rstrip(b"\r")
        del self.left[: i + 1]
        return out

    def take(self, size: int) -> bytes:
        while len(self.left) < size:
            if not self._more():
                raise ArchiveError(f"a record declares {size} bytes; {len(self.left)} are left")
        out = bytes(self.left[:size])
        del self.left[:size]
        return out


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record but the version block."""
    s = Stream(content)
    fields: list[str] | None = None
    while (line := s.line()) is not None:
        if not line:
            continue
        parts = line.decode("utf-8", "surrogateescape").split(" ")
        if line.startswith(b"filedesc://"):
            body = s.take(_length(parts[-1])).decode("utf-8", "surrogateescape").splitlines()
            version = int(body[0].split(" ")[0]) if body and body[0][:1].isdigit() else 0
            if version not in FIELDS:
                raise ArchiveError(f"unknown archive version: {body[:1]}")
            fields = body[1].split(" ") if len(body) > 1 and body[1].startswith("URL ") else FIELDS[version]
            continue
        if fields is None:
            raise ArchiveError("a record comes before the version block")
        if len(parts) < len(fields):
            raise ArchiveError(f"a header line has {len(parts)} fields, not {len(fields)}")
        parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]  # only a URL may hold spaces
        yield dict(zip(fields, parts)), s.take(_length(parts[-1]))


def _length(text: str) -> int:
    if not text.isdigit():
        raise ArchiveError(f"no record length: {text!r}")
    return int(text)


def iso_date(date: str) -> str:
    """An archive date of 8 to 14 digits as an ISO timestamp; what is missing or out of range becomes the first such time."""
    d = re.sub(r"\D", "", date)[:14]
    d = d + "00000101000000"[len(d) :] if len(d) >= 4 else "19700101000000"
    month, day = (d[4:6] if "01" <= d[4:6] <= "12" else "01"), (d[6:8] if "01" <= d[6:8] <= "31" else "01")
    hour, minute, second = (x if x <= most else "00" for x, most in ((d[8:10], "23"), (d[10:12], "59"), (d[12:14], "59")))
    return f"{d[:4]}-{month}-{day}T{hour}:{minute}:{second}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with the blank line, and its payload; a content that is no HTTP message is payload alone."""
    if content[:5] == b"HTTP/" and (i := content.find(b"\r\n\r\n")) >= 0:
        return content[: i + 4], content[i + 4 :]
    return b"", content


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(target: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{target} {date} {digest} {key}')}>"


def _sections(records: Iterator[bytes], start: Callable[[int], bytes], end: bytes, most: int) -> Iterator[pd.DataFrame]:
    """Sections of ``most`` bytes of records between ``end``, or one longer record, each after what ``start`` gives for its number; one without records if there are none."""
    number, part, size = 0, [start(0)], 0
    for r in records:
        if size and size + len(r) > most:
            yield pd.DataFrame({"value": [end.join(part)]})
            number += 1
            part, size = [start(number)], 0
        part.append(r)
        size += len(r)
    yield pd.DataFrame({"value": [end.join(part)]})


def _batches(rows: Iterator[tuple], columns: list[str], weight: int) -> Iterator[pd.DataFrame]:
    """Frames of rows, each of about ``BATCH_BYTES`` of the column at ``weight``."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += 64 + len(r[weight] or b"")
        if size >= BATCH_BYTES:
            yield pd.DataFrame(part, columns=columns)
            part, size = [], 0
    if part:
        yield pd.DataFrame(part, columns=columns)


def _save(sections: DataFrame, path: str, end: bytes) -> None:
    out = sections.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("maxRecordsPerFile", ARCHIVE_BYTES // BATCH_BYTES).text(path)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Write ``page_id``, ``url``, ``html`` as ARC files, of version 1 and 2 by turns of partitions: an HTTP response for each row, its page in a header."""
    most = BATCH_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        body = f"{version} 0 tradeloom\n{' '.join(FIELDS[version])}\n".encode()

        def start(number: int) -> bytes:
            name = f"part-{part}-{number}.arc"
            return f"filedesc://{name} 0.0.0.0 {date} text/plain {f'200 - - 0 {name} ' if version == 2 else ''}{len(body)}\n".encode() + body

        def records() -> Iterator[bytes]:
            offset = 0
            for b in batches:
                for page, url, text in zip(b["page_id"], b["url"], b["html"]):
                    payload = text.encode("utf-8") if isinstance(text, str) else b""
                    name = quote(page, safe="") if isinstance(page, str) else None
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{'' if name is None else f'X-Page-Id: {name}' + CRLF.decode()}\r\n".encode()
                    target = re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url) if isinstance(url, str) and url else f"urn:page:{name or ''}"
                    extra = f"200 - - {offset} part-{part}.arc " if version == 2 else ""
                    record = f"{target} 0.0.0.0 {date} text/html {extra}{len(head) + len(payload)}\n".encode() + head + payload
                    offset += len(record) + 1
                    yield record

        yield from _sections(records(), start, b"\n", most)

    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    _save(slim.mapInPandas(run, "value binary"), path, b"\n")


RECORD = ["record_id", "target", "ip", "date", "page", "size", "digest", "head", "payload"]
RECORD_TYPES = "record_id string, target string, ip string, date string, page string, size long, digest string, head binary, payload binary"


def page_of(head: bytes) -> str | None:
    """The page that a header names."""
    name = http_field(head, "X-Page-Id")
    return None if name is None else unquote(name)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files: a new id, target, address, ISO date, page (the ``X-Page-Id`` header), payload size and SHA-1 (hex), HTTP head and payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                for name, content in zip(b["path"], b["content"]):
                    name = posixpath.basename(name)
                    for n, (fields, body) in enumerate(arc_records(content)):
                        head, payload = split_http(body)
                        digest, date = hashlib.sha1(payload).hexdigest(), iso_date(fields["Archive-date"])
                        yield record_id(fields["URL"], date, digest, f"{name} {n}"), fields["URL"], fields["IP-address"], date, page_of(head), len(payload), digest, head, payload if payloads else None

        yield from _batches(rows(), RECORD, 8)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD_TYPES)


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def responses(records: DataFrame, least: int = REVISIT_BYTES, page_type: str = "bigint") -> DataFrame:
    """``digest``, ``r_record_id``, ``r_target`` of the response of each payload of at least ``least`` bytes that several records share: the record of the
    largest page as a ``page_type`` (pages of that type before others and none), ties to the greatest target, date and id."""
    order = F.struct(F.expr(f"try_cast(page as {page_type})").alias("page"), "target", "date", "record_id")
    best = records.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(order).alias("best")).where("n > 1")
    return best.select("digest", F.col("best.record_id").alias("r_record_id"), F.col("best.target").alias("r_target"), F.lit(True).alias("shared"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_BYTES, page_type: str = "bigint") -> None:
    """Convert ARC files to WARC files. Of several equal rows one is the response, as of any equal payloads."""
    winners = common.written(responses(read_arc(spark, arc_path, payloads=False), least, page_type), "responses")
    met = read_arc(spark, arc_path).join(winners, "digest", "left")
    revisits = F.coalesce(F.col("shared") & (F.col("size") >= least) & (F.col("r_record_id") != F.col("record_id")), F.lit(False))
    met = met.select("record_id", "target", "ip", "date", "digest", "head", F.when(~revisits, F.col("payload")).alias("payload"), revisits.alias("revisit"), "r_record_id", "r_target")
    most = BATCH_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        info = b"software: tradeloom\r\nformat: WARC File Format 1.0\r\n"

        def start(number: int) -> bytes:
            name = record_id("warcinfo", "", "", f"{warc_path} {part} {number}")
            return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info

        def records() -> Iterator[bytes]:
            for b in batches:
                for r in b.itertuples(index=False):
                    block = r.head + (b"" if r.revisit else r.payload)
                    lines = [
                        "WARC/1.0",
                        f"WARC-Type: {'revisit' if r.revisit else 'response'}",
                        f"WARC-Record-ID: {r.record_id}",
                        f"WARC-Date: {r.date}",
                        f"WARC-Target-URI: {r.target}",
                        f"WARC-IP-Address: {r.ip}",
                        "Content-Type: application/http; msgtype=response",
                        f"WARC-Payload-Digest: sha1:{_base32(r.digest)}",
                        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
                    ]
                    if r.revisit:
                        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {r.r_record_id}", f"WARC-Refers-To-Target-URI: {r.r_target}"]
                    lines.append(f"Content-Length: {len(block)}")
                    yield "\r\n".join(lines).encode("utf-8", "surrogateescape") + CRLF + CRLF + block

        yield from _sections(records(), start, CRLF + CRLF, most)

    common.bound_batches(spark)
    _save(met.mapInPandas(run, "value binary"), warc_path, CRLF + CRLF)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    s = Stream(content)
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no record header: {line[:40]!r}")
        fields = {}
        while field := s.line():
            name, _, value = field.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, s.take(_length(fields.get("content-length", "")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files: id, type, page, full payload's size and SHA-1 (hex), and the id a revisit refers to. A response
    whose payload does not have its declared digest is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "record_type", "page", "payload_bytes", "payload_digest", "refers_to_id"]

        def rows():
            for b in batches:
                for content in b["content"]:
                    for fields, block in warc_records(content):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != declared:
                            raise ArchiveError(f"{fields.get('warc-record-id')} does not have its declared digest")
                        size = len(payload) if kind == "response" else int(http_field(head, "Content-Length") or 0)
                        yield fields.get("warc-record-id"), kind, page_of(head), size, declared, fields.get("warc-refers-to")

        yield from _batches(rows(), columns, 0)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record_id string, record_type string, page string, payload_bytes long, payload_digest string, refers_to_id string")


def archived(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Input: ``page_id`` of any type that can be written as text and read again, ``url``, ``html``; other columns are ignored. A null html is an empty
    payload, a null url a name made of the page; a null page comes back as null, and is the response of shared payloads only where no record
    of the group has a page. Repeated rows stay records of their own: one of them may be the response of the others. Payloads of any
    length are kept whole. An empty table gives an empty result.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    common.bound_batches(spark)
    arc, warc = common.scratch(spark, "arc"), common.scratch(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, page_type=kind)
    found = common.written(read_warc(spark, warc), "records")
    page = F.expr(f"try_cast(page as {kind})")
    whole = common.again(found).where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), page.alias("refers_to"))
    out = found.join(whole, "refers_to_id", "left")
    return out.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    return archived(common.table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("record_id")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT payload_digest, max(page_id) AS response_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN r.response_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.response_id <> d.page_id THEN r.response_id END AS refers_to
FROM d LEFT JOIN r ON r.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""
