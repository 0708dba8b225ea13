"""WARC archives: written as one gzip stream, normalised to a gzip member for each record, read back by an offset index.

A writer task puts its records into one whole-file gzip stream. The normaliser inflates that stream once, piece by piece,
and writes each record anew as a gzip member of its own, with the member's offset and length in a sidecar index (one JSON
line per record). Readers seek by the index, so a record can be read without what stands before it.

Equal payloads of at least REVISIT_BYTES bytes are stored once: the record with the smallest page id is the response, the
others are revisit records that name it and keep its HTTP header, whose Content-Length is that of the full payload.

Defined cases: a null payload is empty; a null url is an empty one; a null id is left out of the header and read back as
null, and is never what others refer to unless the group has no other id, in which case all of them are responses. Rows
that repeat an id and a payload are responses alike, as a record can't revisit itself. Very long payloads are compressed
and read back as one record, in the memory that their row takes. An empty table writes no archive.
Columns other than id, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAYBE, replace_file, shared_dir, sieved, store, written

REVISIT_BYTES = 100
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip member


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC record with its closing blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"WARC-Page-ID: {quote(str(page))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {quote(str(refers_to))}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source: io.RawIOBase, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, in pieces of bounded size."""
    member = zlib.decompressobj(GZIP)
    begun = False
    while data := source.read(piece):
        while data:
            begun = True
            if out := member.decompress(data, piece):
                yield out
            data = member.unconsumed_tail
            if member.eof:
                data, member, begun = member.unused_data, zlib.decompressobj(GZIP), False
    if begun:
        raise ValueError("the gzip stream ends early")


def put(out: io.RawIOBase, data: bytes) -> int:
    out.write(data)
    return len(data)


def normalise(source: io.RawIOBase, out: io.RawIOBase, level: int = 6, piece: int = PIECE) -> Iterator[dict]:
    """Rewrites a WARC file as one gzip member per record to ``out``; yields the index entries.

    The input is inflated once. What is held is a record's header and one piece, whatever a record's length.
    """
    stream, held, at = inflate(source, piece), bytearray(), 0
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (more := next(stream, None)) is None:
                if held:
                    raise ValueError("a record's header ends early")
                return
            held += more
        head = fields(bytes(held[:end]))
        left = end + 4 + int(head["content-length"]) + 4
        member, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
        while left:
            if not held:
                if (more := next(stream, None)) is None:
                    raise ValueError("a record's block ends early")
                held += more
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            size += put(out, member.compress(part))
        size += put(out, member.flush())
        yield {"offset": at, "length": size, "type": head["warc-type"], "id": head["warc-record-id"], "digest": head["warc-payload-digest"]}
        at += size


def parse(data: bytes, of: Callable[[str], object]) -> tuple:
    """(page id, payload bytes, payload digest, type, refers to, payload or None) of one record. ``of`` reads an id."""
    end = data.index(b"\r\n\r\n")
    head = fields(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    length = next(int(x.split(b":")[1]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page, other = (of(unquote(x)) if (x := head.get(k)) is not None else None for k in ("warc-page-id", "warc-refers-to-page-id"))
    digest, payload = head["warc-payload-digest"].removeprefix("sha256:"), None
    if head["warc-type"] == "response":
        payload = block[cut:]
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {head['warc-record-id']}: the payload doesn't match its digest")
    return page, length, digest, head["warc-type"], other, payload


def decide(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is the page to refer to, null for a response."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    first = rows.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "warc-first")
    # Only payloads that may stand more than once move; a digest with many rows is split over tasks by adaptive execution.
    known = sieved(rows, first.select("digest"))
    alone = known.where(~F.col(MAYBE)).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    met = known.where(F.col(MAYBE)).join(first, "digest", "left")
    return alone.unionByName(met.select(*alone.columns)).select("id", "url", "payload", "digest", F.when(F.col("first") != F.col("id"), F.col("first")).when(F.col("id").isNull(), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 6) -> DataFrame:
    """Writes all pages; returns (archive, records, bytes), a row for each archive, with its index beside it."""
    base = shared_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = posixpath.join(base, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
        first = next((x for x in batches if len(x)), None)
        if first is None:
            return
        count = 0

        def whole(out) -> None:
            nonlocal count
            gz = zlib.compressobj(1, zlib.DEFLATED, GZIP)

            def each():
                yield first
                yield from batches

            for batch in each():
                for page, url, payload, digest, to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first")), strict=True):
                    out.write(gz.compress(record(page, url, payload, digest, to, to is not None)))
                    count += 1
            out.write(gz.flush())

        replace_file(f"{name}.whole", whole)
        files, path = store(f"{name}.whole")
        entries: list[dict] = []
        with files.open_input_stream(path, compression=None) as source:
            replace_file(name, lambda out: entries.extend(normalise(source, out, level)))
        replace_file(f"{name}.idx", lambda out: out.write("".join(json.dumps(x) + "\n" for x in entries).encode()))
        files.delete_file(path)
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [sum(x["length"] for x in entries)]})

    decided = decide(pages, id_col, url_col, payload_col)
    return written(decided.mapInArrow(write, "archive string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, read member by member."""
    of = str if id_type == "string" else int

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string() if of is str else pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string() if of is str else pa.int64())])
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, path = store(archive)
                with files.open_input_stream(f"{path}.idx", compression=None) as x:
                    entries = [json.loads(line) for line in x.read().splitlines()]
                with files.open_input_file(path) as x:
                    for k in range(0, len(entries), 1000):
                        rows = []
                        for entry in entries[k : k + 1000]:
                            x.seek(entry["offset"])
                            rows.append(parse(zlib.decompress(x.read(entry["length"]), GZIP), of)[:5])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    many = max(1, archives.count())
    kind = "string" if of is str else "bigint"
    out = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"
    return archives.select("archive").repartition(many).mapInArrow(read, out)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
