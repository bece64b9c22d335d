"""WARC archives: one gzip member a record, written by partition and read back by byte range.

A reading task owns the records whose member begins inside its range.  It looks
for the gzip magic from the start of the range, tries each place it finds by
decoding the first bytes of the member, which must be a WARC version line and
its header, and then decodes member after member, the last one beyond the end
of the range.  Ranges of one archive therefore need no index and no agreement.
UTF-8 payloads cannot hold the magic unpacked (0x8b never follows 0x1f), and a
chance find inside packed data fails to decode.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_rows import map_arrow, record, slices
from .files import open_store, reader, writer
from .shared import Scratch

_MAGIC = b"\x1f\x8b\x08"
_FILES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_READ_SQL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def pack_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        safe = "".join(c if c.isprintable() and c not in " %" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _unquote(url: str | None) -> str | None:
    if url is None or "%" not in url:
        return url
    first, *rest = url.encode().split(b"%")
    return b"".join([first, *(bytes([int(p[:2], 16)]) + p[2:] for p in rest)]).decode()


def parse_record(data: bytes) -> tuple:
    """Columns of _READ from an unpacked record; the digest of a response is taken from its payload anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, declared = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (digest(payload) != declared or len(payload) != size):
        raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    return _page(field["WARC-Record-ID"]), _unquote(field.get("WARC-Target-URI")), kind, _page(field.get("WARC-Refers-To")), size, declared, payload if kind == "response" else None


def is_record(data: bytes) -> bool | None:
    """Whether a gzip member that begins ``data`` opens with a whole WARC header; None: more bytes are needed."""
    try:
        head = zlib.decompressobj(31).decompress(data, 1 << 16)
    except zlib.error:
        return False
    if not b"WARC/1.".startswith(head[:7]):
        return False
    lines = head.partition(b"\r\n\r\n")
    if not lines[1]:
        return None if len(head) < 1 << 16 else False
    names = {line.partition(b":")[0].strip().lower() for line in lines[0].split(b"\r\n")[1:]}
    return {b"warc-type", b"warc-record-id", b"content-length"} <= names


def read_range(path: str, start: int, end: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Unpacked records whose member begins in [start, end).  A member that has a WARC header but
    doesn't unpack to its end is damage, an error; all other finds of the magic are passed over."""
    file = reader(path)
    size = file.size()
    at, buffer, base = start, bytearray(), start  # buffer: the bytes of the file from base on

    def fill(until: int) -> None:
        while base + len(buffer) < min(until, size):
            more = file.read_at(min(chunk, size - base - len(buffer)), base + len(buffer))
            if not more:
                return
            buffer.extend(more)

    while at < end:
        if at - base > chunk:
            del buffer[: at - base]
            base = at
        fill(at + 2 * len(_MAGIC))
        found = buffer.find(_MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(buffer) - len(_MAGIC) + 1)
            if base + len(buffer) >= size:
                return
            fill(base + len(buffer) + chunk)
            continue
        at = base + found
        if at >= end:
            return
        ahead, sound = 4096, None
        while sound is None:
            fill(at + ahead)
            sound = is_record(bytes(buffer[found : found + ahead]))
            if sound is None and base + len(buffer) >= size and found + ahead >= len(buffer):
                sound = False
            ahead *= 4
        if not sound:
            at += 1
            continue
        unpacker, parts, place = zlib.decompressobj(31), [], found
        while not unpacker.eof:
            fill(base + place + chunk)
            piece = bytes(buffer[place : place + chunk])
            if not piece:
                raise ValueError(f"{path} ends inside a record")
            parts.append(unpacker.decompress(piece))
            place += len(piece) - len(unpacker.unused_data)
        at = base + place
        yield b"".join(parts)


def with_references(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: null for the records that hold their payload.

    Payloads are compared by SHA-1.  The pairs (digest, smallest id) of payloads that occur more
    than once are written first, so the join reads two plain tables and a payload that very many
    pages share is split between tasks.
    """
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    sized = rows.filter(F.octet_length("payload") >= min_bytes)
    repeated = sized.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")
    repeated = scratch.table(repeated, "repeated")
    later = (F.col("original") != F.col("page_id")) | F.col("page_id").isNull()
    is_long = F.octet_length("payload") >= min_bytes
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", F.when(later & is_long & F.col("original").isNotNull(), F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, archive_bytes: int = 256 << 20, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> list[dict]:
    """Writes a record for each row; returns path, size and records of each archive.

    Of records with equal payloads of at least ``min_bytes`` those with the smallest id are
    responses (repeated rows of that id each), the others revisits of that id; a null payload is
    empty; a null id is written as such and never referred to.  Tasks name their archives anew, and only those of tasks
    that ended well are returned.
    """
    folder = scratch.path("archives")

    def run(batches):
        done, out, path, size, records = [], None, "", 0, 0
        for batch in batches:
            for rows in slices(batch, 2):
                for page, url, payload, refers in zip(*(c.to_pylist() for c in rows.columns)):
                    if out is None:
                        path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = writer(path)
                    member = pack_record(page, url, payload, refers, refers is not None)
                    out.write(member)
                    size, records = size + len(member), records + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, size, records))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        if done:
            yield record(_FILES, *zip(*done))

    rows = with_references(pages, scratch, min_bytes, id_column, url_column, html_column)
    written = scratch.table(map_arrow(rows, run, "path string, size long, records long"), "files")
    return [r.asDict() for r in written.collect()]


def read_archives(spark: SparkSession, files: list, split_bytes: int = 16 << 20) -> DataFrame:
    """One row for each record of the archives, read in ranges of ``split_bytes``: page_id, url,
    record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits).
    ``files``: what ``write_archives`` returns, or paths, whose sizes Spark's file listing gives."""
    known = [(f["path"], f["size"]) for f in files if not isinstance(f, str)]
    paths = [f for f in files if isinstance(f, str)]
    listed = spark.createDataFrame(known, "path string, size long")
    if paths:
        listed = listed.union(spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size")))
    ranges = listed.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    count = ranges.count()

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                found, held = [], 0
                for data in read_range(path, start, min(start + split_bytes, size)):
                    found.append(parse_record(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield record(_READ, *zip(*found))
                        found, held = [], 0
                if found:
                    yield record(_READ, *zip(*found))

    return map_arrow(ranges.repartition(max(count, 1)), run, _READ_SQL)
