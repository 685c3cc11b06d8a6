"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary; a frame for each record follows, so a reader can start at any
of them. Executors write and read the archives in shared storage; what a task wrote counts only once its manifest row is there,
so a lost executor or a repeated task leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, hash_share, materialise, small_batches, tidy

#: Magic number of the skippable frame for dictionaries in WARC files.
DICTIONARY_FRAME = 0x184D2A5D
#: Records from which the dictionary is built, the bytes used of each, and the dictionary's size.
DICTIONARY_RECORDS, DICTIONARY_RECORD_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
#: Compressed bytes from which a new archive begins.
ARCHIVE_BYTES = 32 << 20
#: Payloads from this size are written once.
REVISIT_BYTES = 1000
LEVEL = 3
CHUNK = 1 << 16
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. digest: hex SHA-1 of the payload. With refers_to a revisit, which has the HTTP head but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record that record() wrote; a payload that doesn't match its digest raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": None if page == "none" else int(page), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": digest, "refers_to": None, "payload": payload}
    out["payload_bytes"] = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if out["record_type"] == REVISIT:
        out |= {"refers_to": int(fields["WARC-Refers-To"][len("<urn:page:") : -1]), "payload": None}
    elif hashlib.sha1(payload).hexdigest() != digest or len(payload) != out["payload_bytes"]:
        raise ValueError(f"the payload of page {page} does not match its digest")
    return out


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records; of few or tiny ones their own bytes, the last being the nearest."""
    import zstandard

    if len(records) >= 16 and sum(map(len, records)) >= 4 * size:
        try:
            return zstandard.train_dictionary(size, records).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return (b"WARC/1.1\r\n" * 2 + b"".join(records))[-size:]


def dictionary_frame(body: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads from revisit_bytes on, the largest page_id is the one that others refer to.

    Only digests that occur twice or more are joined back, so most payloads match nothing; a frequent digest is split by the skew join.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = small_batches(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    large = F.octet_length("html") >= revisit_bytes
    firsts = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", other.alias("refers_to"))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", directory: str | None = None, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes one record for each row of pages into archives and returns their manifest: path, records, bytes.

    A null html is an empty payload, a null url leaves the target out, a null page_id never stands for a payload. Repeated rows are records of
    their own; those with the largest page_id are all responses. An empty table gives an empty manifest. directory: shared storage; a new
    folder by default.
    """
    spark = pages.sparkSession
    target = directory or fresh_dir(spark, "warc")
    n = pages.count()
    sample = pages.where(hash_share(page_id, DICTIONARY_RECORDS / max(1, n))).select(F.col(page_id).cast("long"), url, F.substring(F.coalesce(F.col(html), F.lit("")).cast("binary"), 1, DICTIONARY_RECORD_BYTES))
    # bounded: DICTIONARY_RECORDS records, about, of DICTIONARY_RECORD_BYTES at most
    shared = dictionary([record(r[0], r[1], bytes(r[2]), hashlib.sha1(bytes(r[2])).hexdigest(), None, date) for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, base = filesystem(target)
        store.create_dir(base, recursive=True)
        zip_up = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared)).compress
        out = path = None
        count = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{target}/{path}"], "records": [count], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{base}/{path}")
                    out.write(frame := dictionary_frame(shared))
                    size = len(frame)
                frame = zip_up(record(row[0], row[1], row[2].encode(), row[3], row[4], date))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(marked(pages, page_id, url, html, revisit_bytes).mapInArrow(tidy(run), "path string, records long, bytes long"), "warc-manifest")


def records(stream) -> Iterator[bytes]:
    """The records of an archive, decompressed one after the other; the stream is read once, in chunks."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        one, parts = unzip.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := stream.read(CHUNK)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read(manifest: DataFrame, payloads: bool = True, rows: int = 2000) -> DataFrame:
    """A row for each record of the manifest's archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (of responses)."""
    fields = {k: v for k, v in FIELDS.items() if payloads or k != "payload"}
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = filesystem(path)
                with store.open_input_stream(inside) as stream:
                    held: list[dict] = []
                    for raw in records(stream):
                        held.append(parse(raw))
                        if len(held) == rows:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema)

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    parts = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(parts, "path").mapInArrow(tidy(run), ", ".join(f"{k} {names[v]}" for k, v in fields.items()))
