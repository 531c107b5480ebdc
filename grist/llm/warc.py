"""WARC archives: one gzip member per record, written per task and read back sequentially.

The reader inflates incrementally, frames a record by its content length, and
verifies block and payload digests as the bytes pass, so memory does not depend
on the size of a record or file.

Records with equal payloads of at least ``least`` bytes: those with the smallest
page id are responses, the others revisits that refer to it.  Several rows with
that smallest id are all responses; null ids are never the smallest unless all
are null, and then all are responses.  A null page has an empty payload, a null
url no target header.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, written

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

ID = "urn:x-page:"
READ = 1 << 16


def digest_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; with ``revisits`` a revisit of that page's response, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    headers = {
        "WARC-Type": "response" if revisits is None else "revisit",
        "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Refers-To": None if revisits is None else f"<{ID}{revisits}>",
        "WARC-Profile": None if revisits is None else IDENTICAL_PAYLOAD,
        "WARC-Payload-Digest": f"sha1:{digest_text(hashlib.sha1(payload).digest())}",
        "WARC-Block-Digest": f"sha1:{digest_text(hashlib.sha1(block).digest())}",
        "Content-Type": HTTP_TYPE,
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n") + packer.compress(block) + packer.compress(END) + packer.flush()


class Damaged(ValueError):
    """An archive that is cut off, framed wrongly or doesn't fit its digests."""


class Member:
    """The inflated bytes of one gzip member, on demand."""

    def __init__(self, file, held: bytes):
        self.file, self.raw, self.zip, self.out = file, held, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while not self.zip.eof:
            raw = self.raw or self.file.read(READ)
            self.raw = b""
            if not raw:
                raise Damaged("a gzip member is cut off")
            try:
                self.out += self.zip.decompress(raw, READ)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            self.raw = self.zip.unconsumed_tail
            if self.out:
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (i := self.out.find(mark)) < 0:
            n = len(self.out)
            if n > most or not self._grow():
                raise Damaged("headers without an end")
        found, self.out = self.out[:i], self.out[i + len(mark) :]
        return found

    def _grow(self) -> bool:
        held, self.out = self.out, b""
        more = self._more()
        self.out = held + self.out
        return more

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise Damaged("a record is shorter than its content length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part

    def finish(self) -> bytes:
        """Checks the end of the record; returns what was read of the next member."""
        if b"".join(self.take(len(END))) != END or self.out or self._more():
            raise Damaged("a record is longer than its content length")
        return self.zip.unused_data or self.raw


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(file, payloads: bool = False) -> Iterator[dict]:
    """The records of an open archive in order, digests verified; payload bytes only if asked for."""
    held = b""
    while True:
        held = held or file.read(READ)
        if not held:
            return
        member = Member(file, held)
        first, head = _headers(member.until(END))
        if not first.startswith("WARC/"):
            raise Damaged("not a WARC record")
        length = int(head["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        kept, count, http = [], 0, b""
        in_http = head.get("content-type", "").startswith("application/http")
        for part in member.take(length):
            block.update(part)
            if in_http:
                http += part
                if (i := http.find(END)) < 0:
                    continue
                part, http, in_http = http[i + len(END) :], http[:i], False
            payload.update(part)
            count += len(part)
            if payloads:
                kept.append(part)
        held = member.finish()
        revisit = head["warc-type"] == "revisit"
        said = head.get("warc-payload-digest", "")
        if head.get("warc-block-digest") not in (None, f"sha1:{digest_text(block.digest())}") or not revisit and said not in ("", f"sha1:{digest_text(payload.digest())}"):
            raise Damaged(f"digest of {head.get('warc-record-id')}")
        yield {
            "type": head["warc-type"],
            "id": head["warc-record-id"].strip("<>"),
            "url": head.get("warc-target-uri"),
            "refers_to": (head.get("warc-refers-to") or "").strip("<>") or None,
            "payload_bytes": int(_headers(http)[1].get("content-length", count)) if revisit else count,
            "payload_digest": said.partition(":")[2] or digest_text(payload.digest()),
            "payload": b"".join(kept) if payloads else None,
        }


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes an archive per task and returns the manifest (path, records, bytes); names of unfinished tasks don't get into it."""
    rows = pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    equal = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(written(equal, "equal"), "digest", "left")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records, size, path = None, 0, 0, ""
        for batch in batches:
            for page, target, page_html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, name = filesystem(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                data = record(page, target, page_html.encode("utf-8", "surrogatepass"), None if first is None or first == page else first)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return written(joined.select("page_id", "url", "html", "first").mapInArrow(write, "path string, records long, bytes long"), "manifest")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix(ID)
    return int(number) if number else None


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                fs, name = filesystem(path)
                with fs.open_input_stream(name, compression=None) as file:
                    for r in read_records(file):
                        rows.append({"page_id": _page(r["id"]), "url": r["url"], "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["type"], "refers_to": _page(r["refers_to"])})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes fresh archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_folder(spark, "warc"), id, url, html, least))
