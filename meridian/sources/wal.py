"""The write-ahead log's byte format, as a scan, a sink and a Python data source.

Little-endian frames: u32 length of what follows (checksum and body), u32 crc32 of the body, then the body: u8 op
(0 upsert, 1 delete), u64 hlc, u64 id, u32 dim, dim f32, u32 payload length, payload. A reader stops at the first
frame that is cut short, fails its checksum or is malformed, and says where the good part ends; it never changes
its input.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

UPSERT, DELETE = 0, 1
_FRAME, _HEAD, _LEN = struct.Struct("<II"), struct.Struct("<BQQI"), struct.Struct("<I")
SCHEMA = "offset long, end long, op string, hlc long, id long, vector array<float>, payload binary"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.binary()]
_NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]
#: Records of a segment file at most, and bytes but for its last record.
SEGMENT_RECORDS, SEGMENT_BYTES = 1_000_000, 128 << 20


def encode(op: int, hlc: int, id_: int, vector=(), payload: bytes = b"") -> bytes:
    v = np.asarray(vector, "<f4")
    body = _HEAD.pack(op, hlc, id_, len(v)) + v.tobytes() + _LEN.pack(len(payload)) + payload
    return _FRAME.pack(len(body) + 4, zlib.crc32(body)) + body


def _body(body: memoryview) -> tuple[int, int, int, list[float], bytes] | None:
    if len(body) < _HEAD.size + _LEN.size:
        return None
    op, hlc, id_, dim = _HEAD.unpack_from(body)
    at = _HEAD.size + 4 * dim
    if op not in (UPSERT, DELETE) or at + _LEN.size > len(body):
        return None
    (n,) = _LEN.unpack_from(body, at)
    if at + _LEN.size + n != len(body):
        return None
    return op, hlc, id_, np.frombuffer(body, "<f4", dim, _HEAD.size).tolist(), bytes(body[at + _LEN.size :])


def read(f) -> Iterator[tuple]:
    """(offset, end, op, hlc, id, vector, payload) of the good frames of an open file, in order, a frame in memory."""
    at = 0
    while len(head := f.read(_FRAME.size)) == _FRAME.size:
        size, crc = _FRAME.unpack(head)
        if size < 4:
            return
        body = f.read(size - 4)
        if len(body) < size - 4 or zlib.crc32(body) != crc or (r := _body(memoryview(body))) is None:
            return
        end = at + 4 + size
        yield at, end, "delete" if r[0] == DELETE else "upsert", *r[1:]
        at = end


def decode(blob: bytes) -> Iterator[tuple]:
    """The same of some bytes."""
    return read(io.BytesIO(blob))


def good_end(blob: bytes) -> int:
    return max((r[1] for r in decode(blob)), default=0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def scan(spark: SparkSession, segments: str | DataFrame) -> DataFrame:
    """The good records of segments, with the file's name: of a manifest (path, ...), as write() gives it, or of all
    files under a path. Only a manifest leaves out what attempts of tasks wrote that did not count."""
    if isinstance(segments, str):
        paths = spark.read.format("binaryFile").load(segments).select("path")
    else:
        paths = segments.select("path").repartition(max(1, segments.count()), "path")

    def run(batches):
        from pyarrow import fs as pafs

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                    rows = []
                    for r in read(f):
                        rows.append(r)
                        if len(rows) == 4096:
                            yield _named(rows, name)
                            rows = []
                    if rows:
                        yield _named(rows, name)

    return paths.mapInArrow(run, "file string, " + SCHEMA)


def _named(rows: list[tuple], name: str) -> pa.RecordBatch:
    b = _batch(rows)
    return pa.record_batch([pa.array([name] * len(rows), pa.string()), *b.columns], names=["file", *_NAMES])


def write(log: DataFrame, folder: str, segment_records: int = SEGMENT_RECORDS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes log(op, hlc, id, vector, payload) as segments, one or more a task: the manifest (path, records), which
    must be written once, as the segments are written whenever it is computed.

    op is upsert or delete; a delete has neither vector nor payload. Each attempt of a task writes files of new
    names, so only what the returned rows name counts.
    """

    scheme = folder.split("://", 1)[0]

    def run(batches):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        sink, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for op, hlc, id_, vector, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.wal", 0, 0
                    sink = fs.open_output_stream(name)
                gone = op == "delete"
                frame = encode(DELETE if gone else UPSERT, hlc, id_, () if gone else vector or (), b"" if gone else payload or b"")
                sink.write(frame)
                n, size = n + 1, size + len(frame)
                if n >= segment_records or size >= segment_bytes:
                    sink.close()
                    done.append((f"{scheme}://{name}", n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{scheme}://{name}", n))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return log.select("op", "hlc", "id", "vector", "payload").mapInArrow(run, "path string, records long")


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            return [_Segment(self.path)]
        scheme = self.path.split("://", 1)[0]
        files = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [_Segment(f"{scheme}://{f.path}") for f in files if f.type == pafs.FileType.File and f.size]

    def read(self, partition):
        from pyarrow import fs as pafs

        fs, name = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
            rows = []
            for r in read(f):
                rows.append(r)
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class WalSource(DataSource):
    """spark.read.format("meridian_wal").load(uri), after spark.dataSource.register(WalSource)."""

    @classmethod
    def name(cls) -> str:
        return "meridian_wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
