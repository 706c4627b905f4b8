"""Approximate search by navigable small-world graphs, one graph a shard.

Graphs are built from live rows per shard, so deletes need no waypoints and a replaced vector is linked anew. A
graph is one binary value; probing maps over graphs and blocks of queries and merges the shards' lists.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.knn import query_blocks

_M64 = (1 << 64) - 1
#: Candidates of a walk that are expanded together.
WIDTH = 8


#: What build() gives.
GRAPH = "shard_idx int, points long, graph binary"


@dataclass(frozen=True)
class Params:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    seed: int = 42

    def __post_init__(self):
        if self.m < 2 or self.m0 < self.m or self.ef_construction < 1:
            raise ValueError("m >= 2, m0 >= m and ef_construction >= 1 are needed")


def _random(seed: int) -> Iterator[int]:
    """SplitMix64."""
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & _M64
        z = seed
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & _M64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _M64
        yield z ^ (z >> 31)


class Graph:
    """A layered proximity graph over rows of a matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: str = "L2", params: Params = Params(), links: list | None = None, entry: int = -1):
        self.ids, self.vectors, self.metric, self.params = ids, np.asarray(vectors, np.float64), metric, params
        self.links: list[list[list[int]]] = links if links is not None else []
        self.entry = entry
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1)) if len(self.vectors) else np.zeros(0)
        self.seen, self.turn = np.zeros(len(ids), np.int64), 0
        if links is None:
            draw = _random(params.seed)
            for node in range(len(ids)):
                u = ((next(draw) >> 11) + 1) / (1 << 53)
                self._insert(node, int(-math.log(u) / math.log(params.m)))

    def distances(self, q: np.ndarray, q_norm: float, nodes: list[int] | slice) -> np.ndarray:
        rows = self.vectors[nodes]
        if self.metric == "L2":
            d = rows - q
            return np.einsum("ij,ij->i", d, d)
        den = self.norms[nodes] * q_norm
        sim = np.divide(rows @ q, den, out=np.zeros(len(rows)), where=den > 0)
        return 1.0 - np.clip(sim, -1.0, 1.0)

    def _nearest(self, q, q_norm, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """Best-first search of a layer: the ef nearest found, ascending by (distance, node), until all are expanded."""
        self.turn += 1
        d, nodes = np.array([x for x, _ in starts]), np.array([n for _, n in starts])
        self.seen[nodes] = self.turn
        fresh = np.ones(len(nodes), bool)
        while len(at := fresh.nonzero()[0][:WIDTH]):
            fresh[at] = False
            new = np.fromiter(chain.from_iterable(self.links[n][layer] for n in nodes[at].tolist()), np.int64)
            new = np.unique(new[self.seen[new] != self.turn])
            if not len(new):
                continue
            self.seen[new] = self.turn
            d, nodes = np.concatenate([d, self.distances(q, q_norm, new)]), np.concatenate([nodes, new])
            best = np.lexsort((nodes, d))[:ef]
            d, nodes, fresh = d[best], nodes[best], np.concatenate([fresh, np.ones(len(new), bool)])[best]
        return list(zip(d.tolist(), nodes.tolist(), strict=True))

    def _between(self, nodes: list[int]) -> np.ndarray:
        """Distances of some nodes to one another."""
        rows = self.vectors[nodes]
        gram = rows @ rows.T
        if self.metric == "L2":
            own = gram.diagonal()
            return own[:, None] + own[None, :] - 2 * gram
        den = np.outer(self.norms[nodes], self.norms[nodes])
        return 1.0 - np.divide(gram, den, out=np.zeros_like(den), where=den > 0)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one is taken unless a taken one is nearer to it than the base is."""
        nodes = [n for _, n in found]
        base, apart = np.array([d for d, _ in found]), self._between(nodes)
        nearest = np.full(len(nodes), np.inf)
        taken, at = [], 0
        while len(taken) < most:
            free = (nearest[at:] >= base[at:]).nonzero()[0]
            if not len(free):
                break
            at += int(free[0])
            taken.append(nodes[at])
            nearest = np.minimum(nearest, apart[at])
            at += 1
        return taken

    def _insert(self, node: int, level: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        q, q_norm = self.vectors[node], self.norms[node]
        top = len(self.links[self.entry]) - 1
        at = [(float(self.distances(q, q_norm, [self.entry])[0]), self.entry)]
        for layer in range(top, level, -1):
            at = self._nearest(q, q_norm, at[:1], 1, layer)
        for layer in range(min(level, top), -1, -1):
            at = self._nearest(q, q_norm, at, self.params.ef_construction, layer)
            most = self.params.m0 if layer == 0 else self.params.m
            chosen = self._spread(at, self.params.m)
            self.links[node][layer] = list(chosen)
            for n in chosen:
                there = self.links[n][layer]
                there.append(node)
                if len(there) > most:
                    ds = self.distances(self.vectors[n], self.norms[n], there).tolist()
                    self.links[n][layer] = self._spread(sorted(zip(ds, there, strict=True)), most)
        if level > top:
            self.entry = node

    def search(self, query, k: int, ef: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, ascending."""
        if self.entry < 0 or k <= 0:
            return []
        q = np.asarray(query, np.float64)
        q_norm = float(np.sqrt(q @ q))
        at = [(float(self.distances(q, q_norm, [self.entry])[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            at = self._nearest(q, q_norm, at[:1], 1, layer)
        found = self._nearest(q, q_norm, at, max(ef, k), 0)
        return sorted((d, int(self.ids[n])) for d, n in found)[:k]

    def to_bytes(self) -> bytes:
        flat = [x for node in self.links for layer in node for x in layer]
        out = io.BytesIO()
        np.savez(
            out,
            ids=np.asarray(self.ids, np.int64),
            vectors=self.vectors,
            levels=np.array([len(x) for x in self.links], np.int32),
            sizes=np.array([len(layer) for node in self.links for layer in node], np.int32),
            flat=np.array(flat, np.int32),
            entry=np.array([self.entry]),
            params=np.array([self.params.m, self.params.m0, self.params.ef_construction, self.params.seed], np.uint64),
            metric=np.array(self.metric),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Graph:
        z = np.load(io.BytesIO(blob), allow_pickle=False)
        links, flat, at, part = [], z["flat"].tolist(), 0, iter(z["sizes"].tolist())
        for n in z["levels"].tolist():
            node = []
            for _ in range(n):
                size = next(part)
                node.append(flat[at : at + size])
                at += size
            links.append(node)
        return cls(z["ids"], z["vectors"], str(z["metric"]), Params(*map(int, z["params"])), links, int(z["entry"][0]))

    def violations(self) -> list[str]:
        """What is wrong with the structure, if anything."""
        out = []
        for n, node in enumerate(self.links):
            for layer, there in enumerate(node):
                if n in there:
                    out.append(f"self-loop at {n}")
                if len(there) > (self.params.m0 if layer == 0 else self.params.m):
                    out.append(f"degree of {n} in layer {layer}")
                if any(x < 0 or x >= len(self.links) or len(self.links[x]) <= layer for x in there):
                    out.append(f"dangling edge at {n}")
        if len(set(np.asarray(self.ids).tolist())) != len(self.ids) or len(self.ids) != len(self.links):
            out.append("ids")
        if self.links and (self.entry < 0 or len(self.links[self.entry]) != max(map(len, self.links))):
            out.append("entry")
        return out


def build(points: DataFrame, metric: str = "L2", params: Params = Params()) -> DataFrame:
    """(shard_idx, points, graph) of live points(shard_idx, id, vector); a shard's size is what shard_count makes it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        g = Graph(pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy()), metric, params)
        return pd.DataFrame({"shard_idx": [pdf["shard_idx"].iloc[0]], "points": [len(pdf)], "graph": [g.to_bytes()]})

    return points.select("shard_idx", "id", "vector").groupBy("shard_idx").applyInPandas(run, GRAPH)


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
    """(qid, id, score, rank): the k nearest found for queries(qid, qvector), probed in blocks against every graph."""
    blocks = query_blocks(queries)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for blob in pdf["graph"]:
                g = Graph.from_bytes(blob)
                for qids, vectors in blocks():
                    rows = [(q, i, d) for q, v in zip(qids.tolist(), vectors, strict=True) for d, i in g.search(v, k, ef)]
                    yield pd.DataFrame(rows, columns=["qid", "id", "score"])

    found = graphs.select("graph").mapInPandas(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").asc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stats(graphs: DataFrame) -> DataFrame:
    """(shard_idx, points, layers, min_degree, max_degree, mean_degree, violations) of layer 0."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for s, blob in zip(pdf["shard_idx"], pdf["graph"], strict=True):
                g = Graph.from_bytes(blob)
                degrees = [len(x[0]) for x in g.links] or [0]
                rows.append((s, len(g.links), max(map(len, g.links), default=0), min(degrees), max(degrees), sum(degrees) / len(degrees), len(g.violations())))
            yield pd.DataFrame(rows, columns=["shard_idx", "points", "layers", "min_degree", "max_degree", "mean_degree", "violations"])

    return graphs.mapInPandas(run, "shard_idx int, points long, layers int, min_degree int, max_degree int, mean_degree double, violations int")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(hits, total, recall) of (qid, id) rows against the exact ones."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    out = hit.agg(F.count("hit").alias("hits"), F.count("*").alias("total"))
    return out.withColumn("recall", F.col("hits") / F.col("total"))
