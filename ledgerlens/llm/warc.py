"""WARC archives with dictionary-compressed records (.warc.zst).

Of records with equal payloads, one is written as a response and the others as
revisits that refer to it. Each archive file begins with a skippable frame that
holds a Zstandard dictionary built from the file's own first records; every
record is a frame of its own, compressed with that dictionary.

Tasks write files of bounded size, each under a name of its own, into a folder
all executors share, and return a manifest row per file; only what the manifest
lists counts, so files of lost or repeated attempts are never read. A task holds
the records a dictionary is built from (at most ``SAMPLE_BYTES`` and one record)
and then one record at a time. Reading is a map over the manifest.

Defined results: NULL html is an empty payload, NULL urls leave the target out.
Payloads below ``MIN_REVISIT_BYTES`` are always responses. Rows that repeat the
least page id of a payload are responses each; a NULL page id is never the
least, and revisits one if the payload has any. Very long payloads are records
like others; an empty table writes no archive and gives no rows. Only the id, url
and html are read, other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from typing import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

MIN_REVISIT_BYTES = 100
DICT_BYTES, SAMPLE_BYTES, FILE_BYTES, LEVEL = 64 << 10, 2 << 20, 64 << 20, 3
#: The skippable frame's magic number, and the revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decide_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, refers_to, payload)``; revisits have
    no payload. Equal payloads are counted map-side, as (digest, least id) alone."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), utf8(html).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return (rows.join(first, "payload_digest", "left").withColumn("refers_to", refers)
            .select("page_id", "url", "payload_bytes", "payload_digest", "refers_to",
                    F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def record_bytes(page_id, url, size, digest, refers_to, payload, date: str) -> bytes:
    """One uncompressed WARC record."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    body = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveFile:
    """One .warc.zst file being written."""

    def __init__(self, folder: str, samples: list[bytes]):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.path, self.records, self.bytes = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
        dictionary = build_dictionary(samples)
        dictionary.precompute_compress(level=LEVEL)
        self.out = self.store.open_output_stream(self.path, compression=None)
        raw = dictionary.as_bytes()
        self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.compressor.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def write_archives(decided: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records of ``decide_records`` below ``folder`` (a URI or path
    that every executor reaches); returns the manifest, written already."""
    def run(batches: Iterator) -> Iterator:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, archive, waiting, size = [], None, [], 0
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

        def begin() -> ArchiveFile:
            opened = ArchiveFile(folder, waiting)
            opened.add(info % (f"<urn:uuid:{uuid.uuid4()}>".encode(), date.encode()))
            for record in waiting:
                opened.add(record)
            waiting.clear()
            return opened

        for batch in batches:
            for row in zip(*[_values(batch.column(i)) for i in range(batch.num_columns)]):
                record = record_bytes(*row, date)
                if archive is None:
                    waiting.append(record)
                    size += len(record)
                    if size >= SAMPLE_BYTES:
                        archive, size = begin(), 0
                else:
                    archive.add(record)
                    if archive.bytes >= FILE_BYTES:
                        done.append(archive.close())
                        archive = None
        if waiting:
            archive = begin()
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(decided.mapInArrow(run, MANIFEST))


def _values(column: pa.Array) -> Iterator:
    return (v.as_py() for v in column)  # one payload at a time


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record of an uncompressed WARC stream."""
    buffer = b""

    def fill(upto: int) -> bool:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < upto:
            more = stream.read(max(1 << 16, upto - have))
            if not more:
                break
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= upto

    while fill(1):
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("archive ends inside a record's header")
        lines = buffer[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = end + 4, int(headers["Content-Length"])
        if not fill(begin + size + 4):
            raise ValueError("archive ends inside a record")
        content, buffer = buffer[begin:begin + size], buffer[begin + size + 4:]
        yield headers, content


def read_file(store, path: str) -> Iterator[dict]:
    """The pages' records of one archive file; payload digests are verified."""
    with store.open_input_stream(path, compression=None) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        dictionary = zstandard.ZstdCompressionDict(raw.read(size))
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True)
        for head, content in _records(stream):
            if head["WARC-Type"] not in ("response", "revisit"):
                continue
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            payload = content.split(b"\r\n\r\n", 1)[1] if head["WARC-Type"] == "response" else None
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{path}: {head['WARC-Record-ID']} differs from its digest")
            number = lambda name: int(head[name]) if name in head else None
            yield {"page_id": number("X-Page-Id"),
                   "payload_bytes": number("X-Payload-Length") if payload is None else len(payload), "payload_digest": digest,
                   "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload}


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives a manifest lists; columns as ``RECORDS``
    (without ``payload`` if not asked for)."""
    columns = [c for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
               if with_payload or c != "payload"]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, types.get(c, pa.string())) for c in columns])

    def run(batches: Iterator) -> Iterator:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for record in read_file(store, path):
                    size += len(record["payload"] or b"") if with_payload else 0
                    rows.append({c: record[c] for c in columns})
                    if len(rows) >= 1000 or size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    declared = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    return manifest.select("path").mapInArrow(run, declared)
