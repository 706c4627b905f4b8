"""Moving shards after a change of membership: what a plan's actions do to states and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import lww
from meridian.operators.meta import ACTIVE, SYNCING

_KEY = ["collection", "shard_idx"]


def transitions(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """(collection, shard_idx, node_id, step, state): the state changes that a plan's acquisitions go through.

    An acquisition is Syncing first and Active once its pull succeeded; where no source answers it stays Syncing.
    Without an Active peer a replica becomes Active at once. sources(collection, shard_idx, ok) says whether any
    Active peer answered.
    """
    got = sources.groupBy(*_KEY).agg(F.max(F.col("ok").cast("int")).alias("ok"))
    rows = plan.where("action in ('acquire', 'activate')").join(got, _KEY, "left")
    steps = F.when(F.col("action") == "activate", F.array(F.lit(ACTIVE))).when(F.coalesce("ok", F.lit(0)) == 1, F.array(F.lit(SYNCING), F.lit(ACTIVE))).otherwise(F.array(F.lit(SYNCING)))
    return rows.select(*_KEY, "node_id", F.posexplode(steps).alias("step", "state"))


def pull(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """What acquiring nodes accept: versions(node_id, shard_idx, id, hlc, ...) of moves(shard_idx, source, target).

    A row counts where the target has not seen the id or has a lower stamp; node_id is then the target.
    """
    sent = versions.join(F.broadcast(moves), (versions["shard_idx"] == moves["shard_idx"]) & (versions["node_id"] == moves["source"])).drop(moves["shard_idx"])
    sent = sent.drop("node_id", "source").withColumnRenamed("target", "node_id")
    have = versions.select("node_id", "id", F.col("hlc").alias("have"))
    return sent.join(have, ["node_id", "id"], "left").where("have is null or hlc > have").drop("have").select(*versions.columns)


def after_pull(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """All replicas' versions with what was pulled."""
    both = versions.withColumn("seq", F.lit(0)).unionByName(accepted.withColumn("seq", F.lit(1)))
    return lww.winners(both, ("node_id", "id")).drop("seq")
