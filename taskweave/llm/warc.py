"""WARC archives: deduplicated writing, and a reader that splits files anywhere.

``write`` puts one gzip member per page into .warc.gz files: a ``response`` record with
the whole payload, or, for a payload of at least ``min_bytes`` that a page of smaller id
has, a ``revisit`` record that names that page and keeps the payload's digest and length.
Files are named at random per task attempt, and only those of attempts that Spark has
committed are in the manifest, so lost executors and repeated tasks leave no double records.

``read`` cuts files into byte ranges. A task looks for the gzip magic from the start of
its range on, takes a candidate for a member if it decodes to a WARC header (and to a
whole member with its checksum), and owns the members that start inside its range; the
last one may be read beyond the range's end. A range without a member start gives none.
Files that ``write`` made hold nothing between members, so a damaged one is an error.

Defined cases: a null page is an empty payload, and empty payloads are equal payloads; a
null url leaves its header out; a null id is written as "none", read as null and is never
the page that others refer to; of repeated rows with the smallest id all are responses.
An empty table gives an empty manifest and no records. One record is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.candidates import dealt
from taskweave.session import output_path, stored

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
HEADER_BYTES = 1 << 16
PAGE = "urn:taskweave:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that all executors share, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def member(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, level: int) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Writes the archives and returns their manifest: (path, records, bytes) of each file."""
    folder = folder or output_path(pages.sparkSession, "warc")
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    digests = stored(rows.where(F.octet_length("html") >= min_bytes).select("id", "sha1"), "warc-digests")
    # The page that the others with the same payload refer to: a row per payload, combined before the shuffle.
    firsts = digests.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = digests.join(dealt(firsts, "sha1"), "sha1").where("id is null or id > first").select(F.col("id").alias("again"), F.col("sha1").alias("digest"), "first").distinct()
    marked = rows.join(again, F.expr("id <=> again and sha1 = digest"), "left").select("id", "url", "html", "sha1", "first")
    place_of(folder)[0].create_dir(place_of(folder)[1], recursive=True)

    def run(batches):
        fs, root = place_of(folder)
        out = name = None
        records = size = 0
        done = []

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(batch[c].to_pylist() for c in ("id", "url", "html", "sha1", "first"))):
                if out is None or size >= FILE_BYTES:
                    close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                raw = member(page_id, url, html.encode(), sha1, first, level)
                out.write(raw)
                records, size = records + 1, size + len(raw)
        close()
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return stored(marked.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Source:
    """Bytes of one open file, read in blocks."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.size = file, size
        self.at, self.data = start, b""

    def need(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on; reading goes forward except after a false magic."""
        if at < self.at or at > self.at + len(self.data):
            self.at, self.data = at, b""
        while self.at + len(self.data) < min(at + n, self.size):
            self.file.seek(self.at + len(self.data))
            if not (more := self.file.read(max(n, READ_BYTES))):
                raise OSError(f"file ends at {self.at + len(self.data)}, its manifest states {self.size} bytes")
            self.data = self.data[max(0, at - self.at) :] + more
            self.at = max(self.at, at)
        return self.data[at - self.at : at - self.at + n]


def decoded(source: Source, start: int) -> tuple[bytes, int] | None:
    """The WARC record that starts at ``start`` and the offset behind it, or None for bytes that only look like one."""
    unpack, parts, at, seen = zlib.decompressobj(31), [], start, 0
    checked = False
    try:
        while not unpack.eof:
            raw = source.need(at, HEADER_BYTES)
            if not raw:
                return None
            parts.append(unpack.decompress(raw))
            seen += len(parts[-1])
            at += len(raw)
            if not checked and (seen >= 7 or unpack.eof):
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    record = b"".join(parts)
    return (record, at - len(unpack.unused_data)) if b"\r\n\r\n" in record else None


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(PAGE)
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(record: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    stated = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "revisit":
        return page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), None, int(fields(http)["content-length"]), stated, "revisit", page_of(warc.get("warc-refers-to"))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload of {warc['warc-record-id']} has digest {digest}, its record states {stated}")
    return page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), payload.decode("utf-8", "replace"), len(payload), digest, "response", None


def members(source: Source, start: int, end: int, gapless: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end).

    A false magic owns nothing. ``gapless`` files hold members and nothing else, as ``write``
    makes them: where one ends the next must start, up to the end of the file, whichever
    range that falls into; a damaged member is an error that names its offset.
    """
    at, known = start, gapless and start == 0
    while at < end:
        if not known:
            window = source.need(at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
        got = decoded(source, at)
        if got is not None:
            yield at, got[0]
            at, known = got[1], gapless
        elif known:
            raise ValueError(f"no whole record at offset {at}")
        else:
            at += 1
    # The next range can't tell a damaged first member from a false magic; this one can.
    if known and at < source.size and decoded(source, at) is None:
        raise ValueError(f"no whole record at offset {at}")


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's files; ``payloads=False`` leaves the payload column null. A damaged file is an error."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "start"))):
                fs, name = place_of(path)
                out = []
                with fs.open_input_file(name) as file:
                    for offset, record in members(Source(file, start, size), start, min(start + split_bytes, size), gapless=True):
                        row = parsed(record)
                        out.append((*row[:2], row[2] if payloads else None, *row[3:], path, offset))
                columns = zip(*out) if out else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    long, text = pa.int64(), pa.string()
    types = {"page_id": long, "url": text, "payload": text, "payload_bytes": long, "payload_digest": text, "record_type": text, "refers_to": long, "path": text, "offset": long}
    schema = pa.schema(list(types.items()))
    # Ranges are few and small rows: deal them out evenly.
    spread = ranges.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path", "start")
    return spread.mapInArrow(run, RECORDS)
