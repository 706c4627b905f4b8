"""A collection on disk: immutable batches of a versioned log, snapshots, and manifests that publish them.

A manifest is one small file of a new number, put in place by a rename; it is the only commit point. Batches have
log sequence numbers, and replay after a snapshot goes by those, never by byte offsets. Each creation of a
collection has a folder of its own, so a dropped one cannot come back. Rows are (id, vector, payload, hlc,
tombstone, lsn, seq, shard_idx), written in a folder for each shard. The graphs of a collection's shards are kept
beside its snapshot with the sequence number up to which they know its points.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.errors import AlreadyExists, NotFound
from meridian.operators import hnsw, lww, placement
from meridian.operators.meta import Schema
from meridian.sources import files

_FIELDS = {"id": T.LongType(), "vector": T.ArrayType(T.FloatType()), "payload": T.BinaryType(), "hlc": T.LongType(), "tombstone": T.BooleanType(), "lsn": T.LongType(), "seq": T.LongType(), "shard_idx": T.IntegerType()}
ROW = T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()])
SNAPSHOT_MB = 128


class Store:
    """The collections under a root; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, snapshot_mb: int = SNAPSHOT_MB):
        if snapshot_mb <= 0:
            raise ValueError("snapshot_mb must be positive")
        self.spark, self.root, self.snapshot_mb = spark, root.rstrip("/"), snapshot_mb

    def _folder(self, name: str) -> str:
        return f"{self.root}/{quote(name, safe='').replace('.', '%2E')}"

    def _manifests(self, name: str) -> list[str]:
        return [x for x in files.names(self.spark, self._folder(name)) if x.startswith("manifest-") and x.endswith(".json")]

    def manifest(self, name: str) -> dict:
        found = self._manifests(name)
        m = json.loads(files.read_text(self.spark, f"{self._folder(name)}/{found[-1]}")) if found else {}
        if not m.get("schema"):
            raise NotFound(name)
        return m

    def _publish(self, name: str, m: dict) -> None:
        found = self._manifests(name)
        n = int(found[-1].split("-")[1].split(".")[0]) + 1 if found else 0
        if not files.publish(self.spark, f"{self._folder(name)}/manifest-{n:010d}.json", json.dumps(m)):
            raise RuntimeError(f"another writer published {name}")

    def exists(self, name: str) -> bool:
        try:
            self.manifest(name)
        except NotFound:
            return False
        return True

    def create(self, name: str, schema: Schema) -> None:
        if self.exists(name):
            raise AlreadyExists(name)
        self._publish(name, {"schema": vars(schema), "data": f"{self._folder(name)}/{uuid.uuid4().hex}", "batches": [], "snapshot": None, "graphs": None, "lsn": 0, "hlc": 0})

    def drop(self, name: str) -> None:
        """Publishes that the collection is gone, then deletes its data."""
        m = self.manifest(name)
        self._publish(name, {"schema": None})
        files.delete(self.spark, m["data"])

    def schema(self, name: str) -> Schema:
        return Schema(**self.manifest(name)["schema"])

    def append(self, name: str, rows: DataFrame, hlc: int) -> dict:
        """Adds rows(id, vector, payload, hlc, tombstone, seq) as a batch, which is returned; hlc is the highest stamp
        given so far. A batch's size is kept with it, so that no folder is measured twice."""
        m = self.manifest(name)
        lsn, path = m["lsn"] + 1, f"{m['data']}/part=log-{uuid.uuid4().hex}"
        rows = rows.withColumn("lsn", F.lit(lsn)).withColumn("shard_idx", placement.shard_for_id(F.col("id"), m["schema"]["shard_count"]))
        rows.select(*[F.col(f.name).cast(f.dataType) for f in ROW]).write.partitionBy("shard_idx").parquet(path)
        batch = {"path": path, "lsn": lsn, "bytes": files.size(self.spark, path)}
        m |= {"lsn": lsn, "hlc": max(m["hlc"], hlc), "batches": [*m["batches"], batch]}
        self._publish(name, m)
        if sum(b["bytes"] for b in m["batches"]) >= self.snapshot_mb << 20:
            self.snapshot(name)
        return batch

    def read(self, paths: list[str]) -> DataFrame:
        """The rows of some batches and snapshots, in one scan."""
        if not paths:
            return self.spark.createDataFrame([], ROW)
        base = paths[0].rsplit("/", 1)[0]
        return self.spark.read.schema(ROW).option("basePath", base).parquet(*paths).select(*ROW.names)

    def log(self, name: str) -> DataFrame:
        """The rows of the snapshot, if there is one, and of the batches after it."""
        m = self.manifest(name)
        return self.read([b["path"] for b in m["batches"]] + ([m["snapshot"]["path"]] if m["snapshot"] else []))

    def versions(self, name: str, shards: list[int] | None = None) -> DataFrame:
        """Winners of all ids, tombstones included; literal shards prune folders."""
        log = self.log(name)
        return lww.winners(log if shards is None else log.where(F.col("shard_idx").isin(shards)))

    def snapshot(self, name: str) -> None:
        """Writes the winners as a snapshot and drops the batches it covers once it is published; graphs, if there are
        any, are built anew for it."""
        m = self.manifest(name)
        path = f"{m['data']}/part=snapshot-{uuid.uuid4().hex}"
        self.versions(name).write.partitionBy("shard_idx").parquet(path)
        old = [b["path"] for b in m["batches"]] + ([m["snapshot"]["path"]] if m["snapshot"] else [])
        self._publish(name, m | {"batches": [], "snapshot": {"path": path, "lsn": m["lsn"]}})
        for p in old:
            files.delete(self.spark, p)
        if m["graphs"]:
            self.index(name)

    def index(self, name: str, params: hnsw.Params = hnsw.Params()) -> None:
        """Builds the graphs of all shards' live points and publishes them with the sequence number that they reach."""
        m = self.manifest(name)
        path = f"{m['data']}/graphs-{uuid.uuid4().hex}"
        hnsw.build(lww.live(self.versions(name)), m["schema"]["metric"], params).write.parquet(path)
        self._publish(name, m | {"graphs": {"path": path, "lsn": m["lsn"]}})
        if m["graphs"]:
            files.delete(self.spark, m["graphs"]["path"])

    def graphs(self, name: str) -> tuple[DataFrame, DataFrame] | None:
        """The graphs and the log's rows after them; None where there are none, or a snapshot has taken in such rows."""
        m = self.manifest(name)
        g = m["graphs"]
        if not g or (m["snapshot"] and m["snapshot"]["lsn"] > g["lsn"]):
            return None
        return self.spark.read.schema(hnsw.GRAPH).parquet(g["path"]), self.read([b["path"] for b in m["batches"] if b["lsn"] > g["lsn"]])
