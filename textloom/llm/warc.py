"""WARC archives: writing, and normalising monolithic gzip files.

``write_archives`` streams records into whole-file gzip archives, the layout that many
tools leave behind and that nothing can seek in. ``normalise`` inflates each such stream
once, rewrites every record as a gzip member of its own, and writes a sidecar index of
offsets; ``read_records`` goes through the index.

An archive is a row (archive, data), so that it can be written and committed by Spark to
any store; files come in by ``spark.read.format("binaryFile")``. Archives are closed at
``ARCHIVE_BYTES`` and normalised parts at ``PART_BYTES``, which bounds a task's memory.

Nulls: a null payload is empty, a null address is empty, a null page_id is written as no
id and read back as null. Repeated rows are records of their own. Of records with equal
payloads of at least ``least`` bytes the one with the largest page_id is the response;
rows that share that id with it are responses too.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.sources.tables import checkpoint

ARCHIVE_BYTES = 4 << 20
PART_BYTES = 8 << 20
CHUNK = 1 << 18
#: Compression level of members.
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ARCHIVE = "archive string, data binary"
NORMAL = "archive string, part int, data binary, index array<struct<record_id: string, offset: bigint, length: bigint>>"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages as (page_id, url, html, digest, n, refers_to): null for responses.

    Counting by digest is combined before its shuffle; only digests that occur twice are
    joined back, and that join can be split where one payload is very common.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html).alias("digest"))
    twice = (
        rows.where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & F.col("response").isNotNull())
        .select("digest", "response")
    )
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(twice, "digest", "left").withColumn("refers_to", F.when(other, F.col("response"))).drop("response")


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
            f"WARC-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame) -> DataFrame:
    """Whole-file gzip archives of rows from ``mark_revisits``; one or more per partition."""

    def run(batches):
        stream, parts, size, first = None, [], 0, None

        def close():
            data = b"".join([*parts, stream.flush()])
            name = f"pages-{first}-{hashlib.sha1(data).hexdigest()[:16]}.warc.gz"
            return pa.RecordBatch.from_pylist([{"archive": name, "data": data}], schema=pa.schema([("archive", pa.string()), ("data", pa.binary())]))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                if stream is None:
                    stream, parts, size, first = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0, page_id
                parts.append(stream.compress(record_bytes(page_id, url, html.encode(), digest, refers)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, ARCHIVE)


def _inflate(data: bytes):
    """The contents of gzip data, chunk by chunk; members may follow each other."""
    view, at = memoryview(data), 0
    unpack = zlib.decompressobj(31)
    while at < len(view):
        yield unpack.decompress(view[at : at + CHUNK])
        at += CHUNK
        while unpack.eof and unpack.unused_data:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            yield unpack.decompress(rest)
        if unpack.eof and at < len(view):
            unpack = zlib.decompressobj(31)
    if not unpack.eof:
        raise ValueError("the gzip stream ends early")


def _records(chunks):
    """Records of a WARC stream: (header fields, all bytes of the record, place of the block)."""
    held = bytearray()
    head = length = None
    for chunk in chunks:
        held += chunk
        while True:
            if head is None:
                cut = held.find(b"\r\n\r\n")
                if cut < 0:
                    break
                lines = held[:cut].decode().split("\r\n")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
                length = cut + 4 + int(head["Content-Length"])
            if len(held) < length + 4:
                break
            yield head, bytes(held[: length + 4]), length - int(head["Content-Length"])
            del held[: length + 4]
            head = None
    if held:
        raise ValueError("the last record is cut off")


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with a gzip member per record, and where each member lies in its part.

    Rows without data are passed over; a damaged archive fails with its name.
    """
    kind = pa.schema(
        [
            ("archive", pa.string()),
            ("part", pa.int32()),
            ("data", pa.binary()),
            ("index", pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))),
        ]
    )

    def one(name, data):
        out, index, size, part = [], [], 0, 0
        try:
            for head, record, _ in _records(_inflate(data)):
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(record) + pack.flush()
                out.append(member)
                index.append({"record_id": head["WARC-Record-ID"], "offset": size, "length": len(member)})
                size += len(member)
                if size >= PART_BYTES:
                    yield {"archive": name, "part": part, "data": b"".join(out), "index": index}
                    out, index, size, part = [], [], 0, part + 1
        except (ValueError, KeyError, zlib.error) as error:
            raise ValueError(f"archive {name}: {error}") from error
        if index:
            yield {"archive": name, "part": part, "data": b"".join(out), "index": index}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                for row in one(batch.column(0)[i].as_py(), data) if data else ():
                    yield pa.RecordBatch.from_pylist([row], schema=kind)

    return archives.select("archive", "data").mapInArrow(run, NORMAL)


def offset_index(normal: DataFrame) -> DataFrame:
    """The sidecar: (archive, part, record_id, offset, length), a row per record."""
    return normal.select("archive", "part", F.inline("index"))


def read_records(normal: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of normalised archives, each inflated by itself at its offset.

    A response's length and digest are taken from its payload and must agree with its
    header; a revisit's are those of the payload it stands for.
    """

    def run(batches):
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows, held = memoryview(batch.column(0)[i].as_buffer()), [], 0
                for at in batch.column(1)[i].as_py():
                    record = zlib.decompress(data[at["offset"] : at["offset"] + at["length"]], 31)
                    head, whole, block = next(_records([record]))
                    cut = whole.index(b"\r\n\r\n", block) + 4
                    payload = whole[cut:-4]
                    length = int(whole[block:cut].rsplit(b"Content-Length: ", 1)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response":
                        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
                    row = page and int(page), head["WARC-Target-URI"], length, digest, head["WARC-Type"], refers and int(refers), payload if payloads else None
                    rows.append(dict(zip(names, row)))
                    held += len(payload)
                    if held >= PART_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return normal.select("data", "index").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pages written to archives and normalised: the archives, and their sidecar index."""
    written = checkpoint(write_archives(mark_revisits(pages, least)))
    normal = checkpoint(normalise(written))
    return normal, offset_index(normal)
