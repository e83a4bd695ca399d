"""Media columns kept in archives, read through a Spark data source.

``write`` stores one member for each row in archive files: an 8-bit greyscale
PNG whose samples are the payload. An archive ends with a directory of fixed
records (id, offset, length, checksum) in order of offset. The data source
plans byte ranges over the archives of a folder; a task reads the directory of
its archive, takes the members that start in its range, streams them as Arrow
batches and checks each. A member whose bytes can't be read or don't match is
fetched again alone by its offset, and after ``ATTEMPTS`` fetches its row
carries an error in place of the payload.

Writing tasks give files names of their own; only files that the driver's
commit lists are part of the archive folder, so lost or repeated tasks leave
nothing that is read.

A null text is an empty payload before padding. Repeated rows are separate
members. Other columns are ignored. An empty table gives a folder without
members and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from planlens.llm.frames import blobs_of
from planlens.workspace import ship_package

UNIT = 576
WIDTH = 576
RANGE_BYTES = 16 << 20
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
FORMAT = "media_archive"
MANIFEST = "_members.json"
_RECORD = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<i8"), ("length", "<i8"), ("crc", "<u4")])
_TAIL = struct.Struct("<QQ8s")
_MAGIC = b"MEDIADIR"
#: Fixed values of the PNG format.
_PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

SCHEMA = "doc_id long, media binary, error string"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def pad(body: bytes, unit: int = UNIT) -> bytes:
    """``body`` and bytes 255 up to a positive multiple of ``unit``."""
    return body + b"\xff" * (unit * max(1, -(-len(body) // unit)) - len(body))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """Greyscale PNG with the payload as samples, row by row; its length must be a multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG_SIGNATURE + part(b"IHDR", header) + part(b"IDAT", zlib.compress(plain, 2)) + part(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG as ``to_png`` writes it."""
    if media[:8] != _PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width = 8, b"", 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk doesn't match its checksum")
        if kind == b"IHDR":
            width, _, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale is read")
        packed += data if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, a histogram of eight ranges, and a hash of 64 brightness steps."""
    x = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(x >> 5, minlength=8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(65) * len(x) // 65) * 65 // len(x)
    steps = np.packbits(cells[1:] > cells[:-1]).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};hist={','.join(map(str, histogram.tolist()))};steps={steps}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    name: str
    size: int
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        files, out, records, name, at = [], None, [], "", 0

        def close() -> None:
            directory = np.array(records, _RECORD).tobytes()
            out.write(directory + _TAIL.pack(at, len(records), _MAGIC))
            out.close()
            files.append((name, at + len(directory) + _TAIL.size))

        for batch in iterator:
            for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                if out is None:
                    name, at, records = f"{uuid.uuid4().hex}.media", 0, []
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(media)
                records.append((doc or 0, doc is None, at, len(media), zlib.crc32(media)))
                at += len(media)
                if at >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, root = store_of(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        step = self.range_bytes
        ranges = [ByteRange(name, size, a, min(a + step, size)) for name, size in files for a in range(0, size, step)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = store_of(self.path)
        path = f"{root}/{partition.name}"
        members = read_directory(store, path, partition.size)
        first, last = np.searchsorted(members["offset"], [partition.start, partition.end])
        members = members[first:last]
        # members of the directory itself don't exist, so offsets end before it
        while len(members):
            span = members["offset"] + members["length"] - members["offset"][0]
            n = max(1, int(np.searchsorted(span, BATCH_BYTES, side="right")))
            yield fetch(store, path, members[:n])
            members = members[n:]


def read_directory(store: fs.FileSystem, path: str, size: int) -> np.ndarray:
    with store.open_input_file(path) as f:
        begin, count, magic = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} has no directory")
        return np.frombuffer(f.read_at(count * _RECORD.itemsize, begin), _RECORD)


def fetch(store: fs.FileSystem, path: str, members: np.ndarray) -> pa.RecordBatch:
    """Read a run of members at once, and again one by one where that fails."""
    begin = int(members["offset"][0])
    try:
        with store.open_input_file(path) as f:
            run = f.read_at(int(members["offset"][-1] + members["length"][-1]) - begin, begin)
    except OSError:
        run = b""
    media, errors = [], []
    for m in members:
        at, n = int(m["offset"]) - begin, int(m["length"])
        data, error = run[at : at + n], None
        if len(data) != n or zlib.crc32(data) != m["crc"]:
            data, error = fetch_one(store, path, int(m["offset"]), n, int(m["crc"]))
        media.append(data)
        errors.append(error)
    ids = pa.array(members["id"], mask=members["null"].astype(bool))
    return pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary()), pa.array(errors, pa.string())], schema=_FIELDS)


def fetch_one(store: fs.FileSystem, path: str, offset: int, length: int, crc: int) -> tuple[bytes | None, str | None]:
    error = ""
    for _ in range(ATTEMPTS):
        try:
            with store.open_input_file(path) as f:
                data = f.read_at(length, offset)
            if len(data) == length and zlib.crc32(data) == crc:
                return data, None
            error = "checksum differs"
        except OSError as e:
            error = str(e)
    return None, f"{path} at {offset}: {error}"


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(path)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(MediaArchive)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the UTF-8 bytes of every text, padded, as one member each."""
    register(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_png(pad(x)) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary()), pa.nulls(len(batch), pa.string())], schema=_FIELDS)

    blobs_of(docs, id_col, text_col).mapInArrow(draw, SCHEMA).write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, media, error of every member."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(members: DataFrame) -> DataFrame:
    """Sizes, hashes and features of the payloads as read back; a member that can't be read fails the job."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, error in zip(batch.column("media").to_pylist(), batch.column("error").to_pylist()):
                if error:
                    raise OSError(error)
                payload = from_png(media)
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            columns = zip(*rows) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(columns, list(fields)[1:]))], schema=fields)

    return members.select("doc_id", "media", "error").mapInArrow(run, DESCRIBED)
