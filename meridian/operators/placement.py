"""Where points live: hash sharding of ids and a consistent-hash ring of nodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.xxhash import unsigned_mod, xxh64, xxh64_column

VNODES = 64
DEFAULT_SHARDS, DEFAULT_REPLICAS = 8, 3
_RING = 1 << 64


def shard_for_id(id_: Column, shard_count: int) -> Column:
    """XXH64 (seed 0) of the id's eight little-endian bytes, modulo the number of shards."""
    return unsigned_mod(xxh64_column(id_.cast("long")), shard_count)


def shard_of(id_: int, shard_count: int) -> int:
    """The same on the driver, for pruning by literal shards."""
    return xxh64(id_.to_bytes(8, "little", signed=True)) % shard_count


def shard_histogram(points: DataFrame, shard_count: int) -> DataFrame:
    return points.select(shard_for_id(F.col("id"), shard_count).alias("shard_idx")).groupBy("shard_idx").agg(F.count("*").alias("points"))


def vnode_position(node_id: int, vnode: int) -> int:
    return xxh64(node_id.to_bytes(8, "little") + vnode.to_bytes(4, "little"))


def shard_home(collection: str, shard_idx: int) -> int:
    return xxh64(collection.encode() + shard_idx.to_bytes(4, "little"))


def ring(nodes: Iterable[int], vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, node) of all virtual nodes, clockwise."""
    if vnodes <= 0:
        raise ValueError("vnodes must be positive")
    return sorted((vnode_position(n, v), n) for n in set(nodes) for v in range(vnodes))


def replicas(nodes: Iterable[int], collection: str, shard_idx: int, n: int, vnodes: int = VNODES) -> list[int]:
    """A shard's nodes, primary first: by the clockwise distance from its home to a node's nearest virtual node."""
    home = shard_home(collection, shard_idx)
    near: dict[int, int] = {}
    for pos, node in ring(nodes, vnodes):
        d = (pos - home) % _RING
        near[node] = min(d, near.get(node, d))
    return [x for x, _ in sorted(near.items(), key=lambda kv: (kv[1], kv[0]))][:n]


def ring_frame(spark: SparkSession, nodes: Iterable[int], vnodes: int = VNODES) -> DataFrame:
    """(node_id, pos) of the ring; a membership is metadata and small."""
    rows = [(n, str(p)) for p, n in ring(nodes, vnodes)]
    return spark.createDataFrame(rows, "node_id long, pos string").select("node_id", F.col("pos").cast("decimal(20,0)").alias("pos"))


def homes_frame(spark: SparkSession, collections: Iterable[tuple[str, int, int]]) -> DataFrame:
    """(collection, shard_idx, n, home) of collections (name, shard_count, replication_n)."""
    rows = [(c, s, n, str(shard_home(c, s))) for c, count, n in collections for s in range(count)]
    return spark.createDataFrame(rows, "collection string, shard_idx int, n int, home string").withColumn("home", F.col("home").cast("decimal(20,0)"))


def ring_replicas(ring_: DataFrame, homes: DataFrame) -> DataFrame:
    """(collection, shard_idx, rank, node_id): per shard the n nodes of least clockwise distance, rank 0 the primary."""
    whole = F.lit(str(_RING)).cast("decimal(21,0)")
    gap = F.col("pos").cast("decimal(21,0)") - F.col("home").cast("decimal(21,0)")
    near = homes.join(F.broadcast(ring_), F.lit(True)).groupBy("collection", "shard_idx", "n", "node_id").agg(F.min(F.when(gap < 0, gap + whole).otherwise(gap)).alias("gap"))
    w = Window.partitionBy("collection", "shard_idx").orderBy("gap", "node_id")
    return near.withColumn("rank", F.row_number().over(w) - 1).where("rank < n").select("collection", "shard_idx", "rank", "node_id")


def shard_map(placed: DataFrame, states: DataFrame) -> DataFrame:
    """Replicas with their state; without an override a replica is Active."""
    return placed.join(states, ["collection", "shard_idx", "node_id"], "left").withColumn("state", F.coalesce("state", F.lit("Active")))


def ring_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per collection the shards, and how many changed their primary."""
    a = before.where("rank = 0").select("collection", "shard_idx", F.col("node_id").alias("old"))
    b = after.where("rank = 0").select("collection", "shard_idx", F.col("node_id").alias("new"))
    both = a.join(b, ["collection", "shard_idx"], "full_outer")
    return both.groupBy("collection").agg(F.count("*").alias("shards"), F.sum(F.when(F.col("old").eqNullSafe(F.col("new")), 0).otherwise(1)).alias("moved"))
