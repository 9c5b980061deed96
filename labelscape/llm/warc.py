"""WARC archives: a writer for response and revisit records, and a salvage reader (operator 3).

Archives go out and come in through Spark's own sources, so they may lie wherever Spark can write. A row of the
text sink is a chunk of whole gzip members; a member's last byte is the top byte of its length and thus zero for
records under 16 MiB, so the sink's line end (a zero byte) takes its place; a larger record is followed
by an empty member for that purpose.

The reader checks every record (gzip sums, version line, headers, lengths, closing line, digest). After a failed check it
looks for the next gzip member or version line that begins a valid record, inside a member's inflated bytes as well, and logs the
bytes between as a gap. Records of a member that is cut off or damaged further on are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscape.llm.common import rows_of, written
from labelscape.session import scratch_root

VERSION, MEMBER, BREAK = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
#: Payloads below this size are always stored in full.
REVISIT_BYTES = 100
CHUNK_BYTES, CHUNKS_A_FILE = 4 << 20, 4
LINE = re.compile(rb"WARC/1\.[01]\r\n")
PREFIX = "urn:page:"


def member(record: bytes, level: int) -> bytes:
    """One gzip member that ends in a zero byte."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.flush()
    if out[-1]:
        empty = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def record_of(page: int | None, url: str | None, payload: bytes, n: int, digest: str, first: int | None, date: str) -> bytes:
    """A response record, or a revisit record if ``first`` names the page whose payload it repeats."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + payload if first is None else head
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{PREFIX}{'' if page is None else page}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda c: f"%{ord(c[0]):02X}", url),
        "WARC-Refers-To": None if first is None else f"<{PREFIX}{first}>",
        "WARC-Profile": None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + BREAK


def write_pages(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html",
                date: str = "2024-01-01T00:00:00Z", level: int = 4) -> None:
    """Write a record for every row to archives under ``path``.

    Of rows with equal payloads of at least REVISIT_BYTES the one with the smallest key is the response, others revisit it; a null
    payload is empty; rows that repeat the smallest key are responses too; a null key is written without number.
    """
    own = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    own = own.select("page", "url", F.col("payload").cast("binary").alias("payload"),
                     F.sha2("payload", 256).alias("digest"))
    # only repeated payloads; the table is written so that its true size decides how the join is done
    firsts = written(own.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    marked = own.join(firsts, "digest", "left").select(
        "page", "url", F.when(~again, F.col("payload")).alias("payload"), F.octet_length("payload").alias("n"), "digest",
        F.when(again, F.col("first")).alias("first"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows_of(batches):
            for page, link, payload, n, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(member(record_of(page, link, payload or b"", n, digest, first, date), level))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["chunk"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["chunk"])

    marked.mapInArrow(chunks, "chunk binary").select(F.col("chunk").cast("string")).write.option(
        "lineSep", "\0").option("maxRecordsPerFile", CHUNKS_A_FILE).text(path)


class Broken(ValueError):
    """A check failed."""


def inflated(data: bytes, start: int) -> tuple[bytes, int, str]:
    """What comes out of the member that begins at ``start``, where it ends, and what is wrong with it ("" if nothing)."""
    inflate, at, out, step = zlib.decompressobj(31), start, [], 1 << 13
    while not inflate.eof:
        if at >= len(data):
            return b"".join(out), len(data), "member cut off"
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[at:at + step]))
        except zlib.error:
            try:
                for i in range(at, at + step):  # what comes out before the damage
                    out.append(before.decompress(data[i:i + 1]))
            except zlib.error:
                return b"".join(out), i, "member damaged"
        at += step
        step = min(2 * step, 1 << 18)
    return b"".join(out), min(at, len(data)) - len(inflate.unused_data), ""


def parsed(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at ``start``."""
    line = LINE.match(data, start)
    if not line:
        raise Broken("no version line")
    stop = data.find(BREAK, line.end() - 2)
    if stop < 0:
        raise Broken("headers cut off")
    headers: dict[str, str] = {}
    name = ""
    for row in data[line.end():stop].decode("utf-8", "replace").split("\r\n"):
        if row[:1] in (" ", "\t") and name:
            headers[name] += " " + row.strip()
            continue
        name, colon, value = row.partition(":")
        if not colon:
            raise Broken("header damaged")
        name = name.strip().lower()
        headers[name] = value.strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", size):
        raise Broken("no length")
    end = stop + 4 + int(size)
    if data[end:end + 4] != BREAK:
        raise Broken("length or closing line wrong")
    block = data[stop + 4:end]
    kind, _, told = headers.get("warc-block-digest", "").partition(":")
    if kind in ("sha256", "sha1") and told:
        found = hashlib.new(kind, block)
        if told.lower() not in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower()):
            raise Broken("digest wrong")
    return headers, block, end + 4


def within(inside: bytes) -> Iterator[tuple[int, int, dict[str, str] | str, bytes | None]]:
    """Start, end, headers and block of each record in a member, in order; a gap has its reason and no block."""
    at, gap, why = 0, -1, ""
    while at < len(inside):
        try:
            headers, block, end = parsed(inside, at)
        except Broken as error:
            if gap < 0:
                gap, why = at, str(error)
            at = inside.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if gap >= 0:
            yield gap, at, why, None
            gap = -1
        yield at, end, headers, block
        at = end
    if gap >= 0:
        yield gap, len(inside), why, None


Piece = tuple[str, int, int, dict[str, str] | str, bytes, int | None, int | None, str | None]


def salvage(data: bytes) -> Iterator[Piece]:
    """('record', start, end, headers, block, ...) and ('gap', start, end, reason, b'', ...) in order of place; together they cover all bytes but
    empty members. Then follow the start and end in the inflated member (None outside of one) and, of a record whose member is cut off or
    damaged further on, what is wrong there.

    Pieces of one member have its start and end, which is where inflating stopped if it is not sound. The gap after such a member begins where it does;
    its place inside is where the last record ended. A member that is not sound and gives one record only, up to its end, is a gap.
    """
    at, gap, why, inner = 0, -1, "", None
    ahead, read = {MEMBER: -1, VERSION: -1}, 0
    while at < len(data):
        fault, found = "", []
        try:
            if data.startswith(MEMBER, at):
                inside, end, fault = inflated(data, at)
                found = list(within(inside))
                if fault and found and found[-1][3] is None:
                    found.pop()  # the end of it is lost: part of the gap that follows
                if fault and (not found or found[0][:2] == (0, len(inside))):
                    raise Broken(fault)
                if found and all(block is None for *_, block in found):
                    raise Broken(found[0][2])
            else:
                headers, block, end = parsed(data, at)
                found = [(None, None, headers, block)]
        except Broken as error:
            fault, found = str(error), []
        if gap >= 0 and (found or not fault):
            yield "gap", gap, at, why, b"", inner, None, None
            gap = -1
        for first, last, what, block in found:
            if block is None:
                yield "gap", at, end, what, b"", first, last, None
            else:
                yield "record", at, end, what, block, first, last, fault or None
        if not fault:
            at = end
            continue
        if gap < 0:
            gap, why, inner = at, fault, found[-1][1] if found else None
        read = end if found else read  # bytes stored as they are have given their records already
        for sign, least in ((MEMBER, at + 1), (VERSION, max(at + 1, read))):
            if ahead[sign] < least:
                ahead[sign] = data.find(sign, least)
                if ahead[sign] < 0:
                    ahead[sign] = len(data)
        at = min(ahead.values())
    if gap >= 0:
        yield "gap", gap, len(data), why, b"", inner, None, None


SCAN = pa.schema([
    ("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("inside_start", pa.int64()), ("inside_end", pa.int64())])


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, compressed or not.

    Columns: archive, kind ('record' or 'gap'), start, end (bytes in the archive), reason (of a gap, or what is wrong with a record's member further on), record_type, record_id,
    target_uri, refers_to, payload_bytes, payload_digest (bare SHA-256), payload, inside_start, inside_end (bytes in the inflated member). The payload of an HTTP block is what follows its
    headers; a revisit has its payload's size from those headers and its digest from the record's, and a null payload. An
    archive is one task's unit and is held in memory, so Spark's 2 GB limit for a binary value holds for a file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            archive, rows, size = batch.column(0)[0].as_py(), [], 0
            for kind, start, end, what, block, first, last, fault in salvage(batch.column(1)[0].as_py()):
                if kind == "gap":
                    rows.append((archive, kind, start, end, what, None, None, None, None, None, None, None, first, last))
                else:
                    body, n = block, len(block)
                    if what.get("content-type", "").startswith("application/http"):
                        head, _, body = block.partition(BREAK)
                        told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
                        n = int(told[1]) if told and what.get("warc-type") == "revisit" else len(body)
                    if what.get("warc-type") == "revisit":
                        digest, body = what.get("warc-payload-digest", "").partition(":")[2] or None, None
                    else:
                        digest = hashlib.sha256(body).hexdigest()
                    rows.append((archive, kind, start, end, fault, what.get("warc-type"), what.get("warc-record-id"),
                                 what.get("warc-target-uri"), what.get("warc-refers-to"), n, digest, body if payloads else None, first, last))
                    size += len(body or b"") if payloads else 0
                if len(rows) >= 1000 or size > CHUNK_BYTES:
                    yield table_of(rows)
                    rows, size = [], 0
            if rows:
                yield table_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = {"string": "string", "int64": "long", "binary": "binary"}
    return files.mapInArrow(run, ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in SCAN))


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCAN)], schema=SCAN)


def number(column: str) -> F.Column:
    """The page number in a record's name."""
    return F.regexp_extract(column, f"^<{PREFIX}(-?\\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. An empty table makes empty archives and no rows."""
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_archives(spark, path, payloads=False).where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))
