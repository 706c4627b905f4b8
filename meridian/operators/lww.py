"""Last-writer-wins state of a write log (seq, id, hlc, tombstone, ...).

The highest stamp wins; of equal stamps the first arrival, so `seq` must be unique. Winners are found by an
aggregate that combines before the shuffle, so an id that holds much of the log costs each task one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(log: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The winning row of each key, tombstones included, with the log's columns."""
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col("hlc"), -F.col("seq"))).alias("w")
    return log.groupBy(*key).agg(best).select(*key, *[F.col(f"w.{c}").alias(c) for c in rest]).select(*log.columns)


def live(versions: DataFrame) -> DataFrame:
    return versions.where("not tombstone")


def outcomes(log: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The log with `outcome`, what each write met on arrival: Stale if its stamp was not above all earlier ones."""
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("hlc").over(w)
    return log.withColumn("outcome", F.when(F.col("hlc") <= before, F.lit("Stale")).otherwise(F.lit("Applied")))


def get_by_ids(requested: DataFrame, versions: DataFrame) -> DataFrame:
    """Live winners for requested(pos, id), a row for each request that has one; order by pos."""
    return requested.join(live(versions), "id", "inner")


def records(versions: DataFrame, vector: str | None = None) -> DataFrame:
    """All versions, tombstones with an empty vector: what a shard streams to a peer."""
    if vector is None:
        return versions
    kind = versions.schema[vector].dataType
    return versions.withColumn(vector, F.when(F.col("tombstone"), F.array().cast(kind)).otherwise(F.col(vector)))


def merge_replicas(versions: DataFrame) -> DataFrame:
    """(id, hlc, tombstone, ...) of the highest stamp over replica rows (node_id, id, hlc, tombstone, ...), the lowest node at a tie."""
    ranked = versions.withColumnRenamed("node_id", "seq")
    return winners(ranked).drop("seq")


def transfer(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source's versions that a target accepts: unseen ids and strictly higher stamps."""
    have = target.select("id", F.col("hlc").alias("have"))
    return source.join(have, "id", "left").where("have is null or hlc > have").drop("have")
