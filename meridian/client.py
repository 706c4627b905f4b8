"""The collection API: create, drop, upsert, delete, get, search, membership and health."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian import __version__
from meridian.errors import FailedPrecondition, InvalidArgument, Unavailable
from meridian.functions.hlc import Clock
from meridian.functions.vector import METRICS, DimensionError, check_vector
from meridian.operators import hnsw, knn, lww, placement, replication
from meridian.operators.meta import ACTIVE, MetaState, Schema, parse_target
from meridian.sources import files
from meridian.sources.hints import HintTable
from meridian.sources.meta_log import MetaLog
from meridian.sources.store import Store

_POINT = "pos long, id long, vector array<float>, payload binary"


#: Points changed since graphs were built, up to which a search asks those besides the graphs.
GRAPH_TAIL = 1000


class Client:
    """A single writer over a Store. Points are tuples (id, vector, payload or None) or DataFrames with those columns.

    Nodes, collections and the states of shards are the fold of the metadata log under the root, so a new client goes
    on where another stopped. Copies are the storage layer's; which nodes answer is told by mark(), and requests count
    the replicas of the shards that they touch: too few are an error, though what was written stays, with a hint for
    each replica that missed it.
    """

    def __init__(self, spark: SparkSession, root: str, node: tuple[int, str] = (1, "localhost:7000"), clock: Clock | None = None):
        self.spark, self.store = spark, Store(spark, root)
        # No collection's folder has a bare percent sign in its name.
        self.log, self.hints = MetaLog(spark, f"{self.store.root}/%meta"), HintTable(spark, f"{self.store.root}/%hints")
        if not self.log.index:
            self.log.apply("register", node_id=node[0], addr=node[1])
        self.clock, self.down = clock or Clock(), set()

    @property
    def meta(self) -> MetaState:
        return self.log.state

    def create_collection(self, name: str, dim: int, metric: str = "L2", shard_count: int = 0, replication_n: int = 0) -> None:
        """Zero counts take the defaults."""
        if not name:
            raise InvalidArgument("a collection needs a name")
        if dim <= 0:
            raise InvalidArgument("dim must be positive")
        if metric not in METRICS:
            raise InvalidArgument(f"metric must be one of {METRICS}")
        schema = Schema(dim, metric, shard_count or placement.DEFAULT_SHARDS, replication_n or placement.DEFAULT_REPLICAS)
        self.store.create(name, schema)
        self.log.apply("create", name=name, schema=schema)

    def drop_collection(self, name: str) -> None:
        self.store.drop(name)
        self.log.apply("drop", name=name)

    def _stamp(self, name: str) -> int:
        self.clock.last = max(self.clock.last, self.store.manifest(name)["hlc"])
        return self.clock.now()

    def mark(self, node_id: int, up: bool) -> int:
        """Takes notice that a node answers or doesn't; gives how many hints were delivered to one that does."""
        if not up:
            self.down.add(node_id)
            return 0
        self.down.discard(node_id)
        waiting = self.hints.read().where(F.col("target_node") == node_id)
        n = waiting.count()
        if n:
            self.hints.remove(waiting)
        return n

    def set_state(self, name: str, shard_idx: int, node_id: int, state: str) -> None:
        """A replica's state, Active, Syncing or Dead."""
        self.log.apply("set_state", collection=name, shard_idx=shard_idx, node_id=node_id, state=state)

    def _replicas(self, name: str, active: bool) -> dict[int, list[int]]:
        """The nodes of each shard, all of them or the Active ones."""
        out: dict[int, list[int]] = {}
        for collection, shard, _, node, state in self.meta.shard_rows():
            if collection == name and (state == ACTIVE or not active):
                out.setdefault(shard, []).append(node)
        return out

    def _check(self, level: str) -> None:
        if level not in replication.LEVELS:
            raise InvalidArgument(f"consistency must be one of {replication.LEVELS}")

    def _answered(self, name: str, shards: Iterable[int], level: str, active: bool) -> None:
        replicas = self._replicas(name, active)
        n = self.store.schema(name).replication_n
        for shard in shards:
            nodes = replicas.get(shard, [])
            up = sum(x not in self.down for x in nodes)
            if up < replication.needed(level, len(nodes) if not active else min(n, len(self.meta.nodes))):
                raise Unavailable(f"{up} of {len(nodes)} replicas of shard {shard} of {name} answered")

    def _append(self, name: str, rows: DataFrame, hlc: int, level: str) -> None:
        """Writes a batch, leaves hints for replicas that don't answer, and counts the others."""
        batch = self.store.append(name, rows, hlc)
        if not self.down:
            return
        shards = [int(x.split("=")[1]) for x in files.names(self.spark, batch["path"]) if x.startswith("shard_idx=")]
        replicas = self._replicas(name, False)
        missed = [(s, n) for s in shards for n in replicas.get(s, []) if n in self.down]
        if missed:
            targets = self.spark.createDataFrame(missed, "shard_idx int, target_node long")
            op = F.when(F.col("tombstone"), "delete").otherwise("upsert").alias("op")
            self.hints.append(self.store.read([batch["path"]]).join(F.broadcast(targets), "shard_idx").select("target_node", F.lit(name).alias("collection"), "shard_idx", op, "hlc", "id", "vector", "payload"))
        self._answered(name, shards, level, False)

    def upsert(self, name: str, points: DataFrame | Iterable[tuple], consistency: str = "QUORUM") -> int:
        """Replaces points by id; of one id in a request the last counts. Returns how many points were given."""
        self._check(consistency)
        dim = self.store.schema(name).dim
        if not isinstance(points, DataFrame):
            rows = []
            for pos, p in enumerate(points):
                if p[0] is None or p[0] < 0:
                    raise InvalidArgument("ids are from 0 to 2^63 - 1")
                try:
                    rows.append((pos, p[0], check_vector(p[1], dim), bytearray(p[2]) if len(p) > 2 and p[2] is not None else None))
                except DimensionError as e:
                    raise InvalidArgument(str(e)) from e
            points, n = self.spark.createDataFrame(rows, _POINT), len(rows)
        else:
            if "payload" not in points.columns:
                points = points.withColumn("payload", F.lit(None).cast("binary"))
            if "pos" not in points.columns:
                points = points.withColumn("pos", F.monotonically_increasing_id())
            # Computed once, so that what is checked is what is written.
            path = files.shared_path(self.spark, "upsert")
            points.select("pos", "id", "vector", "payload").write.parquet(path)
            points = self.spark.read.schema(_POINT).parquet(path)
            odd = F.col("id").isNull() | (F.col("id") < 0) | F.col("vector").isNull() | (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            found = points.agg(F.count("*").alias("n"), F.coalesce(F.max(odd), F.lit(False)).alias("odd")).first()
            n = found["n"]
            if found["odd"]:
                raise InvalidArgument(f"each point needs an id from 0 and {dim} finite vector elements")
        last = points.groupBy("id").agg(F.max_by(F.struct("vector", "payload", "pos"), "pos").alias("p"))
        hlc = self._stamp(name)
        rows = last.select("id", "p.vector", "p.payload", F.lit(hlc).alias("hlc"), F.lit(False).alias("tombstone"), F.col("p.pos").alias("seq"))
        self._append(name, rows, hlc, consistency)
        return n

    def delete(self, name: str, ids: Iterable[int] | DataFrame, consistency: str = "QUORUM") -> int:
        """Leaves a tombstone for each id, known or not, of a list or of a DataFrame (id); returns how many were given."""
        self._check(consistency)
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id long")
        hlc, n = self._stamp(name), ids.count()
        rows = ids.distinct().select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("binary").alias("payload"), F.lit(hlc).alias("hlc"), F.lit(True).alias("tombstone"), F.lit(0).alias("seq"))
        self._append(name, rows, hlc, consistency)
        return n

    def points(self, name: str) -> DataFrame:
        """All live points."""
        return lww.live(self.store.versions(name))

    def get(self, name: str, ids: Sequence[int], consistency: str = "QUORUM") -> list[tuple]:
        """(id, vector, payload) of the ids that are live, in the order asked, repeats included; only their shards are read."""
        schema = self.store.schema(name)
        self._check(consistency)
        shards = sorted({placement.shard_of(i, schema.shard_count) for i in ids})
        if self.down or self.meta.states:
            self._answered(name, shards, consistency, True)
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id long")
        log = self.store.log(name).where(F.col("shard_idx").isin(shards)).join(F.broadcast(asked.select("id").distinct()), "id", "left_semi")
        rows = lww.get_by_ids(asked, lww.winners(log)).select("pos", "id", "vector", "payload").orderBy("pos").collect()
        return [(r["id"], list(r["vector"]), bytes(r["payload"]) if r["payload"] is not None else None) for r in rows]

    def search(self, name: str, vector: Sequence[float], k: int = 0, ef: int = 0, exact: bool = True) -> list[tuple]:
        """(id, score, payload) of the k nearest, ascending by (score, id); zeros take the defaults.

        exact=False probes the graphs that are kept, and exactly what changed since; they are built where there are none,
        or where more changed than GRAPH_TAIL.
        """
        schema = self.store.schema(name)
        k, ef = k or knn.DEFAULT_K, ef or knn.DEFAULT_EF
        try:
            q = check_vector(vector, schema.dim)
        except DimensionError as e:
            raise InvalidArgument(str(e)) from e
        live = self.points(name)
        if exact:
            top = knn.scored(live, q, schema.metric).select("id", "score", "payload").orderBy(*knn.order()).limit(k).collect()
            return [(r["id"], r["score"], bytes(r["payload"]) if r["payload"] is not None else None) for r in top]
        kept = self.store.graphs(name)
        changed = kept[1].select("id").distinct().limit(GRAPH_TAIL + 1).count() if kept else 0
        if not kept or changed > GRAPH_TAIL:
            self.store.index(name)
            kept, changed = self.store.graphs(name), 0
        graphs, tail = kept
        query = self.spark.createDataFrame([(0, q)], "qid long, qvector array<double>")
        found = hnsw.search(graphs, query, k + changed, max(ef, k + changed)).select("id", "score")
        if changed:
            ids = F.broadcast(tail.select("id").distinct())
            new = knn.scored(live.join(ids, "id", "left_semi"), q, schema.metric).select("id", "score")
            found = found.join(ids, "id", "left_anti").unionByName(new)
        top = found.orderBy(*knn.order()).limit(k)
        rows = live.select("id", "payload").join(F.broadcast(top), "id").orderBy(*knn.order()).collect()
        return [(r["id"], r["score"], bytes(r["payload"]) if r["payload"] is not None else None) for r in rows]

    def cluster_info(self) -> dict:
        return {"nodes": dict(self.meta.nodes), "shard_map": self.meta.shard_rows(), "leader": min(self.meta.nodes, default=0), "version": __version__}

    def join(self, target: str) -> None:
        try:
            node, addr = parse_target(target)
        except ValueError as e:
            raise InvalidArgument(str(e)) from e
        self.log.apply("register", node_id=node, addr=addr)

    def leave(self, node_id: int) -> None:
        if node_id not in self.meta.nodes:
            raise FailedPrecondition(f"node {node_id} is not a member")
        if len(self.meta.nodes) == 1:
            raise FailedPrecondition("the last member cannot leave")
        self.log.apply("deregister", node_id=node_id)
        self.down.discard(node_id)

    def health(self) -> str:
        return "ok"
