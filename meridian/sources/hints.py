"""Hints on disk: writes kept for replicas that could not be reached.

A hint's frame is the log's own, with the target node (u64), the collection's name (u32 length, UTF-8) and the shard
(u32) before the write. HintTable keeps hints as batches of rows; what was delivered is taken away by the hint's
identity, so hints that arrive during a replay stay.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import replication
from meridian.sources import files, wal

_TARGET, _U32 = struct.Struct("<QI"), struct.Struct("<I")
KEY = ["target_node", "collection", "shard_idx", "id", "hlc"]
SCHEMA = "target_node long, collection string, shard_idx int, op string, hlc long, id long, vector array<float>, payload binary"


def encode(target_node: int, collection: str, shard_idx: int, op: int, hlc: int, id_: int, vector=(), payload: bytes = b"") -> bytes:
    name = collection.encode()
    write = wal.encode(op, hlc, id_, vector, payload)[8:]
    body = _TARGET.pack(target_node, len(name)) + name + _U32.pack(shard_idx) + write
    return struct.pack("<II", len(body) + 4, zlib.crc32(body)) + body


def decode(blob: bytes) -> Iterator[tuple]:
    """(target_node, collection, shard_idx, op, hlc, id, vector, payload) of the good frames, up to the first bad one."""
    at = 0
    while at + 8 <= len(blob):
        size, crc = struct.unpack_from("<II", blob, at)
        body = blob[at + 8 : at + 4 + size]
        if size < 4 or at + 4 + size > len(blob) or zlib.crc32(body) != crc or len(body) < _TARGET.size:
            return
        target, n = _TARGET.unpack_from(body)
        if _TARGET.size + n + 4 > len(body):
            return
        try:
            name = body[_TARGET.size : _TARGET.size + n].decode()
        except UnicodeDecodeError:
            return
        (shard,) = _U32.unpack_from(body, _TARGET.size + n)
        write = body[_TARGET.size + n + 4 :]
        found = list(wal.decode(struct.pack("<II", len(write) + 4, zlib.crc32(write)) + write))
        if len(found) != 1:
            return
        yield target, name, shard, *found[0][2:]
        at += 4 + size


class HintTable:
    """Hints in a folder of the shared storage; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[str]:
        found = [n for n in files.names(self.spark, self.folder) if n.endswith(".json")]
        return files.read_text(self.spark, f"{self.folder}/{found[-1]}").split("\n") if found else []

    def _publish(self, batches: list[str]) -> None:
        n = len([x for x in files.names(self.spark, self.folder) if x.endswith(".json")])
        if not files.publish(self.spark, f"{self.folder}/hints-{n:010d}.json", "\n".join(batches)):
            raise RuntimeError("another writer published hints")

    def append(self, hints: DataFrame) -> None:
        name = uuid.uuid4().hex
        hints.select(*[f.split(" ")[0] for f in SCHEMA.split(", ")]).write.parquet(f"{self.folder}/{name}")
        self._publish([*self._batches(), name])

    def read(self) -> DataFrame:
        out = self.spark.createDataFrame([], SCHEMA)
        for b in filter(None, self._batches()):
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{b}"))
        return out

    def remove(self, delivered: DataFrame) -> None:
        """Takes away the delivered hints, by identity."""
        keep = self.read().join(delivered.select(*KEY).distinct(), KEY, "left_anti")
        name = uuid.uuid4().hex
        keep.write.parquet(f"{self.folder}/{name}")
        self._publish([name])

    def clear(self) -> None:
        self._publish([])

    def replay(self, replica_log: DataFrame, nodes: DataFrame) -> DataFrame:
        """Replica states (node_id, id, seq, hlc, tombstone) once all hints for known nodes came in; those are removed."""
        hinted = self.read().select("target_node", "id", F.lit(1 << 62).alias("seq"), "hlc", (F.col("op") == "delete").alias("tombstone"), "collection", "shard_idx")
        state, _ = replication.replay(hinted, replica_log, nodes)
        go = hinted.join(F.broadcast(nodes.select(F.col("node_id").alias("target_node"))), "target_node", "left_semi")
        path = f"{self.folder}/state-{uuid.uuid4().hex}"
        state.write.parquet(path)
        self.remove(go)
        return self.spark.read.parquet(path)
