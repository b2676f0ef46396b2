"""WARC archives in seekable Zstandard bundles.

A bundle is a WARC file in the seekable Zstandard format: its records are grouped
into frames that decompress on their own, and a skippable frame at the end, the seek
table, lists the compressed and plain size of each. Any Zstandard tool reads the
file from front to back. A reader that knows a record's frame and its place in the plain frame
reads the footer, the table and that frame, and nothing else.

Each task writes its pages to bundles of its own, in the shared folder; the rows that
it returns, one for each frame with the places of its records, are the index, and name
all files that count: what a lost attempt has left is never read. No page is
shuffled. Which pages repeat an earlier payload is found by digests alone; the classes of
equal payloads are broadcast if they are counted to be few, else only those with the most
pages are, and pages meet the others by a join.

Of equal payloads of at least ``min_bytes`` bytes, the page with the largest id is written as
a response and the others as revisits, which carry its id, the payload's digest and length
but not the payload. Reading checks each payload against its digest and raises if
they differ.

Defined results: a null html is an empty payload; a null id compares below all others, and is a
response where all ids of its class are null; rows with the same id and payload have the same role
and record id, and all are read back; a null url has no WARC-Target-URI; blanks and control
characters of a url are written as %XX; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import BROADCAST_ROWS, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
READ_BYTES = 64 << 20  # of compressed frames, for a task that reads
FRAMES_TOGETHER = 16
LEVEL = 3

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_PAGE = "urn:page"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record_id(page: str | None) -> str:
    return f"<{_PAGE}>" if page is None else f"<{_PAGE}:{quote(page, safe='')}>"


def page_of(record: str) -> str | None:
    name = record[1 + len(_PAGE) : -1]
    return unquote(name[1:]) if name else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """A response with the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return record(headers, http if revisit else http + payload)


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """A file of frames under way. Holds one frame, and the places of the records of all."""

    def __init__(self, stream, frame_bytes: int, level: int = LEVEL):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.plain: list[bytes] = []
        self.places: list[dict] = []
        self.size = self.total = 0
        self.frames: list[tuple[int, int, list[dict]]] = []  # compressed size, plain size, records

    def add(self, page: str | None, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self._end_frame()
        self.places.append({"page": page, "start": self.size, "length": len(data)})
        self.plain.append(data)
        self.size += len(data)
        self.total += len(data)

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.plain))
        self.stream.write(packed)
        self.frames.append((len(packed), self.size, self.places))
        self.plain, self.places, self.size = [], [], 0

    def close(self) -> None:
        """Write the last frame and the seek table."""
        if self.size:
            self._end_frame()
        entries = b"".join(struct.pack("<II", packed, plain) for packed, plain, _ in self.frames)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries)
        self.stream.write(struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC))
        self.stream.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of the frames of an open file, from its footer."""
    size = source.size()
    count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of this file")
    width = 12 if flags & 0x80 else 8  # with or without checksums
    entries = source.read_at(count * width, size - 9 - count * width)
    table, start = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", entries, k * width)
        table.append((start, packed, plain))
        start += packed
    return table


_RECORDS = "array<struct<page:string,start:bigint,length:bigint>>"
_FRAMES = f"file string, frame int, packed bigint, records {_RECORDS}"


def _with_roles(pages: DataFrame, min_bytes: int, broadcast_rows: int) -> DataFrame:
    """The pages, each with the largest id of its class where another page has its payload."""
    key = F.unhex(F.sha2("payload", 256)).alias("key")
    named = pages.select("*", key)
    alike = named.select("page", "key", F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    classes = alike.groupBy("key").agg(F.max("page").alias("last"), F.count("*").alias("n")).where("n > 1")
    classes = written(classes, "equal-payloads")
    counts = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("pages")).first()
    if counts.classes <= broadcast_rows:
        return named.join(F.broadcast(classes.drop("n")), "key", "left").drop("key")
    # A class with more than this many pages is one of at most broadcast_rows.
    crowd = F.col("n") > counts.pages // broadcast_rows
    crowds, others = classes.where(crowd).drop("n"), classes.where(~crowd).drop("n")
    near = named.join(F.broadcast(crowds.withColumn("crowd", F.lit(True))), "key", "left")
    far = near.where("crowd IS NULL").drop("last", "crowd").join(others, "key", "left")
    return far.unionByName(near.where("crowd").drop("crowd")).drop("key")


def write(
    pages: DataFrame,
    folder: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Archive the pages in the folder; returns the index: file, frame, its compressed size, and
    of each record in it the page, its start in the plain frame and its length."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    chosen = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    roles = _with_roles(chosen, min_bytes, broadcast_rows)
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page"))
    rows = roles.select(F.col("page").cast("string"), "url", "payload", F.col("last").cast("string"), revisit.alias("revisit"))

    def run(batches):
        import pyarrow as pa

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, bundle = "", None

        def index() -> pa.RecordBatch:
            bundle.close()
            sizes, _, records = zip(*bundle.frames)
            kind = pa.list_(pa.struct([("page", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            columns = [pa.array([f"{folder}/{name}"] * len(sizes)), pa.array(range(len(sizes)), pa.int32()), pa.array(sizes, pa.int64()), pa.array(records, kind)]
            return pa.RecordBatch.from_arrays(columns, ["file", "frame", "packed", "records"])

        for batch in batches:
            for page, address, data, last, again in zip(*(c for c in batch.columns)):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                page = page.as_py()
                bundle.add(page, page_record(page, address.as_py(), data.as_py(), last.as_py(), again.as_py(), date))
                if bundle.total >= bundle_bytes:
                    yield index()
                    bundle = None
        if bundle is not None:
            yield index()

    return written(rows.mapInArrow(run, _FRAMES), "warc-index")


def read(
    index: DataFrame,
    *,
    page_id: str = "page_id",
    id_type: str = "bigint",
    payload: bool = True,
    read_bytes: int = READ_BYTES,
) -> DataFrame:
    """<page_id>, url, record_type, refers_to, payload_digest, payload_bytes and (if asked for) the payload, null
    in revisits, of the index's records. Frames are read on their own, a few at a time in a task."""
    spark = index.sparkSession
    total = index.agg(F.sum("packed")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // read_bytes))
    frames = index.select("file", "frame", "records").repartition(tasks, "file", F.floor(F.col("frame") / FRAMES_TOGETHER))
    schema = T.StructType(
        [
            T.StructField(name, T._parse_datatype_string(kind))
            for name, kind in (
                ("page", "string"), ("url", "string"), ("record_type", "string"), ("refers_to", "string"),
                ("payload_digest", "string"), ("payload_bytes", "bigint"), *([("payload", "binary")] if payload else []),
            )
        ]
    )

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * payload
        for batch in batches:
            for data, records in _frames(batch):
                rows = [_read(data[r["start"] : r["start"] + r["length"]], payload) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], schema.names)

    found = frames.sortWithinPartitions("file", "frame").mapInArrow(run, schema)
    ids = {"page": F.col("page").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)}
    return found.withColumns(ids).withColumnRenamed("page", page_id)


def _frames(batch) -> Iterator[tuple[bytes, list[dict]]]:
    """The plain frames that the rows name, found by the seek tables of their files."""
    import zstandard

    zstd, name, source, table = zstandard.ZstdDecompressor(), None, None, []
    for file, frame, records in zip(*(c.to_pylist() for c in batch.columns)):
        if file != name:
            if source:
                source.close()
            system, path = _open(file)
            name, source = file, system.open_input_file(path)
            table = seek_table(source)
        start, packed, plain = table[frame]
        yield zstd.decompress(source.read_at(packed, start), max_output_size=plain), records
    if source:
        source.close()


def _read(data: bytes, with_payload: bool) -> tuple:
    headers, http, payload = parsed(data)
    revisit = headers["WARC-Type"] == "revisit"
    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != told:
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    size = int(http["Content-Length"]) if revisit else len(payload)
    refers_to = page_of(headers["WARC-Refers-To"]) if revisit else None
    row = (page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], refers_to, told, size)
    return (*row, None if revisit else payload) if with_payload else row


def fetch(index: DataFrame, wanted: DataFrame, *, page_id: str = "page_id", **options) -> DataFrame:
    """The records of the wanted pages (a column <page_id>), from their frames alone."""
    each = index.select("file", "frame", "packed", F.explode("records").alias("r"))
    ids = wanted.select(F.col(page_id).cast("string").alias("id")).distinct()
    chosen = each.join(ids, F.col("r.page") == F.col("id"), "left_semi")
    frames = chosen.groupBy("file", "frame", "packed").agg(F.collect_list("r").alias("records"))
    return read(frames, page_id=page_id, **options)
