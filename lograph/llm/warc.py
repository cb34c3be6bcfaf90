"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; every bundle file ends with the seek table
of the seekable Zstandard format (a skippable frame, so plain decoders read the file too). An index maps
each record to its bundle, frame and the offset inside the decompressed frame.

Each task writes bundles of its own into the archive folder under names no other attempt uses, through
the file system that the folder's address names. The index, written by Spark, names the bundles
of the attempts that counted: a lost executor leaves at most files that nothing refers to.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is a
``response``, the others are ``revisit`` records, which keep the digest and length and refer to it.

Cases: a null payload is empty, a null address leaves out the header, a null id is kept as null (and never
referred to while another id has the payload). Rows that share the smallest id of a payload
are all responses. An empty table gives no bundle and an empty index. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads below this many bytes are always stored.
LEAST = 100
#: A frame ends with the record that brings it to this many bytes, a bundle with the frame that brings it to that many.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
#: Bytes of records that a task reads back, on the whole.
READ_BYTES = 1 << 24
#: Fixed values of the seekable format: skippable frame, end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: per frame its compressed and decompressed size, the number of frames, no checksums."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """Per frame: position in the file, compressed size, decompressed size."""
    end = file.size()
    file.seek(end - 9)
    count, kind, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if kind & 0x80 else 8
    file.seek(end - 9 - count * width)
    table = file.read(count * width)
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def record_uri(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, whose block has the response's headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The columns of ``RECORDS`` out of the bytes of a record; digest and length of stored payloads come from the payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stored = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        if len(payload) != stored or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page_id, refers_to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page_id is None else int(page_id), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": None if refers_to is None else int(refers_to), "payload_bytes": stored, "payload_digest": digest,
        "payload": None if revisit else payload,
    }


class Bundle:
    """A bundle file that is being written: records go into the open frame, full frames into the file."""

    def __init__(self, folder: str) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        place = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()



def as_uri(folder: str) -> str:
    """An address as pyarrow's file systems spell it; plain paths are local ones."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        return "file://" + folder.removeprefix("file:")
    return folder.replace("s3a://", "s3://", 1) if "://" in folder else f"file://{folder}"


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Pages as ``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses).

    Only digests that occur twice or more are joined back, so that a corpus without copies shuffles no payload
    when that table is small; adaptive execution splits a digest with very many copies.
    """
    page = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = page.filter(F.length("payload") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 1 and first is not null").select(F.col("digest").alias("of"), "first")
    long_enough = F.length("payload") >= least
    return page.join(firsts, (F.col("digest") == F.col("of")) & long_enough, "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write all pages into bundles under ``folder`` and return the index, itself a table under ``folder``/index."""
    spark = pages.sparkSession
    target = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                bundle = bundle or Bundle(f"{target}/bundles")
                record = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                frame, offset = bundle.add(record)
                rows.append((row["page_id"], bundle.name, frame, offset, len(record)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                    yield index_batch(rows)
                    rows = []
        if bundle:
            bundle.close()
            yield index_batch(rows)

    with_types(pages, **columns).mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "bundle", "frame", "offset", "length"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` lists (all, or some of them), reading only the frames they lie in.

    Frames go to tasks by (bundle, frame); each frame is read and decompressed once.
    """
    target = as_uri(folder)
    names = RECORDS.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(f"{target}/bundles")
        unpack = zstandard.ZstdDecompressor()
        name = file = table = frame = None
        number = -1
        for batch in batches:
            out: list[dict] = []
            held = 0
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name, number = row["bundle"], -1
                    file = system.open_input_file(f"{path}/{name}")
                    table = read_seek_table(file)
                if row["frame"] != number:
                    number = row["frame"]
                    at, packed, plain = table[number]
                    file.seek(at)
                    frame = unpack.decompress(file.read(packed), max_output_size=plain)
                out.append(parse_record(frame[row["offset"]:row["offset"] + row["length"]]))
                held += row["length"]
                if held > 1 << 24:
                    yield record_batch(out, names)
                    out, held = [], 0
            yield record_batch(out, names)

    # The index is small, what it points at is not: tasks are counted by the bytes that they read.
    length = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    placed = index.repartition(1 + length // READ_BYTES, "bundle", F.expr("frame div 16")).sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInArrow(run, RECORDS)


def record_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]))
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)
