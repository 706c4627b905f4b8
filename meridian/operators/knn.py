"""Exact k-nearest-neighbour search: one query, per shard, or a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.vector import check_vector, distance
from meridian.sources import files

DEFAULT_K = 10
DEFAULT_EF = 64
#: Queries of a batch search that go against the points together, and points that a task holds.
QUERY_BLOCK, POINT_BLOCK = 2000, 1 << 16


def order(score: str = "score", id_col: str = "id") -> list[Column]:
    """The total order of results: nearest first, ids break ties, NaN and null last."""
    return [F.col(score).asc_nulls_last(), F.col(id_col).asc()]


def scored(points: DataFrame, query: Sequence[float], metric: str, dim: int | None = None) -> DataFrame:
    """points(id, vector, ...) with a DOUBLE `score` against one query vector."""
    query = check_vector(query, dim)
    return points.withColumn("score", distance(metric, "vector", query, len(query)))


def knn(points: DataFrame, query: Sequence[float], k: int = DEFAULT_K, metric: str = "L2", dim: int | None = None) -> DataFrame:
    """The k nearest live points of one query, planned as TakeOrderedAndProject: each task keeps k rows.

    k = 0 gives no rows; fewer than k points give them all.
    """
    return scored(points, query, metric, dim).select("id", "score").orderBy(*order()).limit(max(0, k))


def shard_topk(points: DataFrame, query: Sequence[float], k: int = DEFAULT_K, metric: str = "L2") -> DataFrame:
    """Each shard's own k nearest. The rank filter is pushed below the exchange (WindowGroupLimit),
    so a shard that holds most points ships k rows per task, not its points."""
    w = Window.partitionBy("shard_idx").orderBy(*order())
    return (
        scored(points, query, metric)
        .select("shard_idx", "id", "score")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def merge_topk(shard_results: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The global k nearest from shards' lists."""
    return shard_results.select("id", "score").orderBy(*order()).limit(k)


def query_blocks(queries: DataFrame, column: str = "qvector") -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Writes queries(qid, qvector) to the shared folder; what is returned reads them in a task, QUERY_BLOCK at a time."""
    path, size = files.shared_path(queries.sparkSession, "queries"), QUERY_BLOCK
    queries.select("qid", F.col(column).cast("array<double>").alias("v")).write.parquet(path)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        from pyarrow import dataset, fs

        where, name = fs.FileSystem.from_uri(path)
        for b in dataset.dataset(name, filesystem=where, format="parquet").to_batches(batch_size=size):
            if b.num_rows:
                yield b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    return blocks


def scores(points: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all points to all queries, added up from the first dimension to the last as the expressions do."""

    def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), b.shape[0]))
        for j in range(a.shape[1]):
            out += a[:, j, None] * b[None, :, j]
        return out

    if metric == "L2":
        out = np.zeros((len(points), len(queries)))
        for j in range(points.shape[1]):
            d = points[:, j, None] - queries[None, :, j]
            out += d * d
        return out
    norms = [np.zeros(len(x)) for x in (points, queries)]
    for x, norm in zip((points, queries), norms, strict=True):
        for j in range(x.shape[1]):
            norm += x[:, j] * x[:, j]
    den = np.sqrt(norms[0])[:, None] * np.sqrt(norms[1])[None, :]
    sim = np.divide(total(points, queries), den, out=np.zeros_like(den), where=den != 0)
    return np.where(den == 0, 1.0, 1.0 - np.clip(sim, -1.0, 1.0))


def knn_join(queries: DataFrame, points: DataFrame, k: int = DEFAULT_K, metric: str = "L2") -> DataFrame:
    """Batch search (an extension): (qid, id, score, rank) for queries(qid, qvector) against all points(id, vector).

    The points are read once. A task holds POINT_BLOCK of them, reads the queries in blocks against those, and keeps k
    rows for each query, so what is shuffled follows blocks of points and queries, not pairs.
    """
    blocks, most = query_blocks(queries), POINT_BLOCK

    def nearest(ids, x):
        for qids, qs in blocks():
            here, best = np.zeros((0, len(qids)), np.int64), np.zeros((0, len(qids)))
            for at in range(0, len(ids), 1024):
                part = np.broadcast_to(ids[at : at + 1024, None], (len(ids[at : at + 1024]), len(qids)))
                here, best = np.concatenate([here, part]), np.concatenate([best, scores(x[at : at + 1024], qs, metric)])
                keep = np.lexsort((here, best), axis=0)[:k]
                here, best = np.take_along_axis(here, keep, 0), np.take_along_axis(best, keep, 0)
            yield pa.record_batch([pa.array(np.tile(qids, len(here))), pa.array(here.ravel()), pa.array(best.ravel())], names=["qid", "id", "score"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)))
            n += b.num_rows
            if n >= most:
                yield from nearest(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from nearest(*map(np.concatenate, zip(*held, strict=True)))

    out = points.select("id", "vector").mapInArrow(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(*order())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
