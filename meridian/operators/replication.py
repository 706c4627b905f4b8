"""Replica semantics as relations: quorums, hints, repair, routing and rebalancing plans.

Replica sets and availability are small tables; writes, versions and responses are not, and are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators import lww


def consistency_count(level: Column, n: Column) -> Column:
    """Replicas that must answer: ONE 1, ALL n, else a majority; within 1 and max(n, 1)."""
    need = F.when(level == "ONE", F.lit(1)).when(level == "ALL", n).otherwise(F.floor(n / 2) + 1)
    return F.greatest(F.lit(1), F.least(need, F.greatest(n, F.lit(1)))).cast("int")


LEVELS = ("ONE", "QUORUM", "ALL", "UNSPECIFIED")


def needed(level: str, n: int) -> int:
    """The same for one set of replicas."""
    need = {"ONE": 1, "ALL": n}.get(level, n // 2 + 1)
    return max(1, min(need, max(n, 1)))


def write_view(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas that a write goes to: all of a shard whose address is known, whatever their state."""
    return placed.join(nodes, "node_id")


def read_view(shard_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas in state Active whose address is known."""
    return shard_map.where("state = 'Active'").join(nodes, "node_id")


def write_outcome(writes: DataFrame, view: DataFrame, level: str = "QUORUM") -> DataFrame:
    """(seq, id, shard_idx, acks, need, ok). A missed quorum takes nothing back: what was written stays.

    The view is counted per shard first, so a write meets one small row and the writes are not multiplied.
    """
    per_shard = view.groupBy("shard_idx").agg(F.count("*").alias("n"), F.sum(F.col("up").cast("int")).alias("acks"))
    out = writes.join(F.broadcast(per_shard), "shard_idx")
    need = consistency_count(F.lit(level), F.col("n"))
    return out.select("seq", "id", "shard_idx", F.col("acks").cast("int").alias("acks"), need.alias("need"), (F.col("acks") >= need).alias("ok"))


def hints(writes: DataFrame, view: DataFrame) -> DataFrame:
    """A hint (target_node, write) for each write and unreachable replica."""
    down = view.where("not up").select("shard_idx", F.col("node_id").alias("target_node"))
    return writes.join(F.broadcast(down), "shard_idx").select("target_node", *writes.columns)


def replay(hinted: DataFrame, replica_log: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replica states after the hints of known nodes arrived, and the hints that stay: their target is unknown."""
    known = nodes.select(F.col("node_id").alias("target_node"))
    go = hinted.join(F.broadcast(known), "target_node", "left_semi").withColumnRenamed("target_node", "node_id")
    cols = replica_log.columns
    state = lww.winners(replica_log.unionByName(go.select(*cols)), ("node_id", "id"))
    return state, hinted.join(F.broadcast(known), "target_node", "left_anti")


def read_quorum(responses: DataFrame, level: str, n: int) -> DataFrame:
    """(id, hlc, tombstone, responses, ok) over (node_id, id, hlc, tombstone): answers per id and the winner.

    An answer without a version has a null hlc; it counts as an answer. An id without any version has null hlc.
    """
    best = F.max_by(F.col("tombstone"), F.struct("hlc", -F.col("node_id")))
    out = responses.groupBy("id").agg(F.max("hlc").alias("hlc"), best.alias("tombstone"), F.count("*").alias("responses"))
    return out.withColumn("ok", F.col("responses") >= consistency_count(F.lit(level), F.lit(n)))


def read_repair(responses: DataFrame) -> DataFrame:
    """(id, node_id, hlc, winner_hlc) of replicas that answered with an older version or none."""
    winner = responses.groupBy("id").agg(F.max("hlc").alias("winner_hlc"))
    behind = responses.join(winner, "id").where("winner_hlc is not null and (hlc is null or hlc < winner_hlc)")
    return behind.select("id", "node_id", "hlc", "winner_hlc")


def search_routing(shard_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """The replica that answers for each shard: reachable, Active ones first, then by ring rank. Shards without any are missing."""
    w = Window.partitionBy("collection", "shard_idx").orderBy((F.col("state") != "Active").cast("int"), "rank")
    reach = shard_map.join(nodes.where("up"), "node_id")
    return reach.withColumn("r", F.row_number().over(w)).where("r = 1").select("collection", "shard_idx", "node_id", "state")


def reconcile_plan(desired: DataFrame, held: DataFrame, has_peer_data: DataFrame) -> DataFrame:
    """(collection, shard_idx, node_id, action) for desired(collection, shard_idx, node_id, state) and
    held(collection, shard_idx, node_id, points).

    keep: Active and holding data, or empty where no Active peer has any; acquire: data is to come from an Active
    peer; activate: no Active peer to copy from; drop: no longer desired and all desired replicas Active; wait:
    no longer desired, but some are not Active yet. has_peer_data(collection, shard_idx, node_id, points) gives
    who could serve.
    """
    key = ["collection", "shard_idx"]
    all_active = desired.groupBy(*key).agg(F.min((F.col("state") == "Active").cast("int")).alias("all_active"))
    active = desired.where("state = 'Active'").select(*key, F.col("node_id").alias("peer"))
    peers = active.join(has_peer_data.select(*key, F.col("node_id").alias("peer"), "points"), [*key, "peer"], "left")
    peers = peers.groupBy(*key).agg(F.collect_set("peer").alias("peers"), F.sum(F.when(F.col("points") > 0, 1).otherwise(0)).alias("with_data"))
    both = desired.withColumn("want", F.lit(True)).join(held, [*key, "node_id"], "full_outer").join(all_active, key, "left").join(peers, key, "left")
    others = F.size(F.array_except(F.coalesce("peers", F.array().cast("array<bigint>")), F.array("node_id"))) > 0
    has_data = F.coalesce("points", F.lit(0)) > 0
    action = (
        F.when(F.col("want").isNull(), F.when(F.col("all_active") == 1, "drop").otherwise("wait"))
        .when((F.col("state") == "Active") & has_data, "keep")
        .when(~others, "activate")
        .when((F.col("state") == "Active") & (F.coalesce("with_data", F.lit(0)) == 0), "keep")
        .otherwise("acquire")
    )
    return both.select(*key, "node_id", action.alias("action"))
