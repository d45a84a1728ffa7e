"""Web archives in seekable Zstandard bundles.

Records are grouped into independent frames; a seek table in a skippable frame closes each
archive, so any frame can be found and unpacked alone. An index maps record identifiers to
archive, frame and offset within the frame. Equal payloads are kept once: the record with
the smallest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_BYTES = 256 << 10  # of records, before compression
READ_BYTES = 32 << 20  # of records that a task reads back
LEVEL = 3
# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables name no capture time
INDEX = "page_id long, archive int, frame int, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, and so the full length, without payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields[b"WARC-Type"] == b"revisit"
    number = lambda name: int(fields[name][len(b"<urn:page:") : -1]) if len(fields[name]) > len(b"<urn:page:>") else None
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r}: payload does not match its digest")
    return {
        "page_id": number(b"WARC-Record-ID"),
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": "revisit" if revisit else "response",
        "refers_to": number(b"WARC-Refers-To") if revisit else None,
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL).compress
        self.held, self.size, self.frames = [], 0, []

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(frame, offset within it, length) of the record."""
        at = len(self.frames), self.size, len(raw)
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self._close_frame()
        return at

    def _close_frame(self) -> None:
        if self.held:
            packed = self.pack(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def finish(self) -> None:
        self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class BundleReader:
    """Random access to the frames of an archive through its seek table."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        frames, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = np.frombuffer(file.read_at(8 * frames, size - 9 - 8 * frames), "<u4").reshape(-1, 2)
        self.sizes = sizes.astype(np.int64)
        self.begin = np.cumsum(self.sizes[:, 0]) - self.sizes[:, 0]

    def frame(self, number: int) -> bytes:
        packed, size = self.sizes[number].tolist()
        return self.unpack(self.file.read_at(packed, int(self.begin[number])), max_output_size=size)


def _archive(base: str, number: int) -> str:
    return f"{base}/archives/bundle-{number:08d}.warc.zst"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html as payload (null: empty), first: smallest page_id with that payload.

    ``first`` is null for a payload that no other row shares. Copies of one payload are
    counted before they are joined, and the few shared digests meet the pages in a join
    that Spark may split where one digest is very frequent.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(shared, "digest", "left").drop("digest")


def write_bundles(pages: DataFrame, path: str) -> None:
    """Write archives of ``pages`` below the new shared folder ``path``, and their index.

    A row is a revisit if a smaller page_id has the same payload; rows that repeat the
    smallest id are responses too. Null ids count as largest. Columns other than page_id,
    url and html are ignored. A task that runs again takes the same archive name.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{base}/archives")
        own = f"{_archive(base, number)}.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as out:
            bundle = BundleWriter(out)
            for batch in batches:
                places = []
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                    revisit = first is not None and page_id != first
                    places.append(bundle.add(record(page_id, url, payload.encode("utf-8", "surrogatepass"), first, revisit)))
                frame, offset, length = zip(*places) if places else ((), (), ())
                arrays = [batch.column(0), pa.array(np.full(len(places), number), pa.int32()), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "archive", "frame", "offset", "length"])
            bundle.finish()
        files.move(own, _archive(base, number))

    marked = mark_revisits(pages).select("page_id", "url", "payload", "first")
    marked.mapInArrow(write, INDEX).write.parquet(f"{path}/index")


def read_records(index: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Records that rows of the index name, parsed from their frames, one row each."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(path)
        archive, frame, reader, data = -1, -1, None, b""
        for batch in batches:
            rows = []
            for a, f, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if a != archive:
                    archive, frame, reader = a, -1, BundleReader(files.open_input_file(_archive(base, a)))
                if f != frame:
                    frame, data = f, reader.frame(f)
                rows.append(parse(data[offset : offset + length]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    # The rows are small; what they make a task read is not.
    bytes_read = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-bytes_read // READ_BYTES))
    ordered = index.repartitionByRange(parts, "archive", "frame", "offset").sortWithinPartitions("archive", "frame", "offset")
    return ordered.select("archive", "frame", "offset", "length").mapInArrow(read, schema + ", payload binary" * with_payload)


def read_bundles(spark: SparkSession, path: str, page_ids: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """All records below ``path``, or those of ``page_ids`` (column page_id)."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    if page_ids is not None:
        index = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    return read_records(index, path, with_payload)
