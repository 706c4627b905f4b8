"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import hlc
from meridian.functions.vector import cosine_distance, l2_squared
from meridian.operators import hnsw, knn, lww, meta, placement, rebalance, replication
from meridian.plans import sqltext as sql
from meridian.session import table
from meridian.sources import files, wal
from meridian.sources.meta_log import MetaLog
from meridian.sources.store import Store
from meridian.streaming import lww as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8
NODES = [1, 2, 3, 4, 5]
DOWN = 3
COLLECTIONS = [("alpha", 8, 3), ("beta", 4, 3)]
STATES = [("alpha", 0, 1, "Syncing"), ("alpha", 4, 5, "Syncing"), ("beta", 1, 2, "Dead"), ("beta", 3, 4, "Syncing")]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("shard_idx", placement.shard_for_id(F.col("id"), SHARDS))


def vector_of(spark: SparkSession, sf_dir: str, id_: int) -> list[float]:
    return list(points(spark, sf_dir).where(F.col("id") == id_).first()["vector"])


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = hlc.millis(F.col("ts")) * 65536 + F.col("event_id") % 65536
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), stamp.alias("hlc"), (F.col("event_type") == "error").alias("tombstone"), F.col("props").alias("payload"), (F.col("event_id") % 3).alias("node_id"))


def late_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its arrival shuffled and its stamps coarsened, so that writes arrive late and tie."""
    n = table(spark, sf_dir, "events").count()
    return write_log(spark, sf_dir).withColumns({"seq": F.col("seq") * 7919 % n, "hlc": F.shiftright("hlc", 44)})


def nodes(spark: SparkSession, which: list[int] = NODES) -> DataFrame:
    return spark.createDataFrame([(n, f"node{n}:7000", n != DOWN) for n in which], "node_id long, addr string, up boolean")


def placed(spark: SparkSession, which: list[int] = NODES) -> DataFrame:
    return placement.ring_replicas(placement.ring_frame(spark, which), placement.homes_frame(spark, COLLECTIONS))


def shard_map(spark: SparkSession) -> DataFrame:
    return placement.shard_map(placed(spark), spark.createDataFrame(STATES, "collection string, shard_idx int, node_id long, state string"))


def sharded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_log(spark, sf_dir).withColumn("shard_idx", placement.shard_for_id(F.col("id"), SHARDS))


def alpha_view(spark: SparkSession) -> DataFrame:
    return replication.write_view(placed(spark).where("collection = 'alpha'"), nodes(spark))


_NODES = sql.values("nodes", "node_id, up", [(n, n != DOWN) for n in NODES])
_STATES = sql.values("states", "collection, shard_idx, node_id, state", STATES)
_PLACED = ", ".join([sql.ring("ring", NODES), sql.homes(COLLECTIONS), sql.placed("placed", "ring")])
_MAP = f"{_PLACED}, {_STATES}, smap AS (SELECT p.*, coalesce(s.state, 'Active') AS state FROM placed p LEFT JOIN states s USING (collection, shard_idx, node_id))"
_SHARDED = f"{sql.LOG}, {sql.hashed('SELECT id FROM wlog')}, sw AS (SELECT w.*, (h % 8)::INTEGER AS shard_idx FROM wlog w JOIN h USING (id))"
_VIEW = f"{_PLACED}, {_NODES}, view_ AS (SELECT p.*, up FROM placed p JOIN nodes USING (node_id) WHERE collection = 'alpha')"
_EMB_HASH = sql.hashed("SELECT vec_id AS id FROM embeddings")


def _knn_sql(id_: int, score: str, extra: str = "") -> str:
    return f"SELECT e.vec_id AS id, {score} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {id_}) q ORDER BY score, id LIMIT 10"


_L2, _COS = sql.l2("e.embedding", "q.embedding"), sql.cosine("e.embedding", "q.embedding")


# Search


@query("knn_exact", _knn_sql(0, _L2))
def knn_exact(spark, sf_dir):
    return knn.knn(points(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, "L2")


@query("search_l2", _knn_sql(1, _L2))
def search_l2(spark, sf_dir):
    return knn.merge_topk(knn.shard_topk(sharded(spark, sf_dir), vector_of(spark, sf_dir, 1), 10, "L2"), 10)


@query("search_cosine", _knn_sql(2, _COS))
def search_cosine(spark, sf_dir):
    return knn.merge_topk(knn.shard_topk(sharded(spark, sf_dir), vector_of(spark, sf_dir, 2), 10, "COSINE"), 10)


@query("distance_l2", f"SELECT e.vec_id AS id, {_L2} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q")
def distance_l2(spark, sf_dir):
    return points(spark, sf_dir).select("id", l2_squared("vector", vector_of(spark, sf_dir, 3), 64).alias("score"))


@query("distance_cosine", f"SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q")
def distance_cosine(spark, sf_dir):
    return points(spark, sf_dir).select("id", cosine_distance("vector", vector_of(spark, sf_dir, 3), 64).alias("score"))


@query(
    "shard_topk",
    f"WITH {_EMB_HASH} SELECT shard_idx, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx ORDER BY score, id) AS rank FROM "
    f"(SELECT (h % 8)::INTEGER AS shard_idx, e.vec_id AS id, {_L2} AS score FROM embeddings e JOIN h ON h.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 1) q)) WHERE rank <= 5",
)
def shard_topk(spark, sf_dir):
    return knn.shard_topk(sharded(spark, sf_dir), vector_of(spark, sf_dir, 1), 5, "L2")


@query(
    "knn_join_topk",
    f"SELECT qid, id, score, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_L2} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank "
    "FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
)
def knn_join_topk(spark, sf_dir):
    return knn.knn_join(query_vectors(spark, sf_dir), points(spark, sf_dir), 10, "L2")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return points(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.build(sharded(spark, sf_dir), "L2")


@query("ann_hnsw_search")
def ann_hnsw_search(spark, sf_dir):
    return hnsw.search(graphs(spark, sf_dir), query_vectors(spark, sf_dir), 10, 64)


@query("ann_recall")
def ann_recall(spark, sf_dir):
    return hnsw.recall(ann_hnsw_search(spark, sf_dir), knn_join_topk(spark, sf_dir))


@query("hnsw_degree_stats")
def hnsw_degree_stats(spark, sf_dir):
    return hnsw.stats(graphs(spark, sf_dir))


# Placement


@query("shard_for_id", f"WITH {_EMB_HASH} SELECT id, (h % 8)::INTEGER AS shard_8, (h % 7)::INTEGER AS shard_7 FROM h")
def shard_for_id(spark, sf_dir):
    id_ = F.col("id")
    return points(spark, sf_dir).select("id", placement.shard_for_id(id_, 8).alias("shard_8"), placement.shard_for_id(id_, 7).alias("shard_7"))


@query("shard_histogram", f"WITH {sql.hashed('SELECT event_id AS id FROM events')} SELECT (h % 8)::INTEGER AS shard_idx, count(*) AS points FROM h GROUP BY 1")
def shard_histogram(spark, sf_dir):
    return placement.shard_histogram(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), SHARDS)


@query("ring_replicas", f"WITH {_PLACED} SELECT collection, shard_idx, rank::INTEGER AS rank, node_id::BIGINT AS node_id FROM placed")
def ring_replicas(spark, sf_dir):
    return placed(spark)


@query("shard_map", f"WITH {_MAP} SELECT collection, shard_idx, rank::INTEGER AS rank, node_id::BIGINT AS node_id, state FROM smap")
def shard_map_(spark, sf_dir):
    return shard_map(spark).select("collection", "shard_idx", "rank", "node_id", "state")


@query(
    "ring_movement",
    f"WITH {sql.homes(COLLECTIONS)}, {sql.ring('r5', NODES)}, {sql.ring('r6', [*NODES, 6])}, {sql.placed('a', 'r5')}, {sql.placed('b', 'r6')} "
    "SELECT collection, count(*) AS shards, sum(CASE WHEN a.node_id = b.node_id THEN 0 ELSE 1 END)::BIGINT AS moved FROM a JOIN b USING (collection, shard_idx) WHERE a.rank = 0 AND b.rank = 0 GROUP BY 1",
)
def ring_movement(spark, sf_dir):
    return placement.ring_movement(placed(spark), placed(spark, [*NODES, 6]))


# Clock and versions


@query("hlc_pack_unpack", f"WITH {sql.LOG} SELECT seq, hlc, hlc // 65536 AS wall_ms, hlc % 65536 AS counter FROM wlog")
def hlc_pack_unpack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    packed = e.select(F.col("event_id").alias("seq"), hlc.pack(hlc.millis(F.col("ts")), F.col("event_id") % 65536).alias("hlc"))
    return packed.select("seq", "hlc", hlc.wall(F.col("hlc")).alias("wall_ms"), hlc.counter(F.col("hlc")).alias("counter"))


@query("upsert_lww", f"WITH {sql.LATE} SELECT id, seq, hlc, tombstone, payload FROM {sql.winners('late')}")
def upsert_lww(spark, sf_dir):
    return lww.winners(late_log(spark, sf_dir)).select("id", "seq", "hlc", "tombstone", "payload")


@query("delete_tombstone", f"WITH {sql.LATE} SELECT id, hlc FROM {sql.winners('late')} WHERE tombstone")
def delete_tombstone(spark, sf_dir):
    return lww.winners(late_log(spark, sf_dir)).where("tombstone").select("id", "hlc")


@query("live_count_per_shard", f"WITH {_SHARDED} SELECT shard_idx, count(*) AS live FROM {sql.winners('sw')} WHERE NOT tombstone GROUP BY 1")
def live_count_per_shard(spark, sf_dir):
    return lww.live(lww.winners(sharded_writes(spark, sf_dir))).groupBy("shard_idx").agg(F.count("*").alias("live"))


@query(
    "lww_outcomes",
    f"WITH {sql.LATE} SELECT seq, id, CASE WHEN hlc <= max(hlc) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'Stale' ELSE 'Applied' END AS outcome FROM late",
)
def lww_outcomes(spark, sf_dir):
    return lww.outcomes(late_log(spark, sf_dir)).select("seq", "id", "outcome")


_REPLICAS = f"{sql.LOG}, rv AS (SELECT node_id, id, hlc, tombstone FROM {sql.winners('wlog', 'node_id, id')})"


def replica_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each replica's state, from the third of the log that reached it."""
    return lww.winners(write_log(spark, sf_dir), ("node_id", "id")).select("node_id", "id", "hlc", "tombstone")


@query("lww_merge_replicas", f"WITH {_REPLICAS} SELECT id, hlc, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, node_id) AS rn FROM rv) WHERE rn = 1")
def lww_merge_replicas(spark, sf_dir):
    return lww.merge_replicas(replica_versions(spark, sf_dir)).select("id", "hlc", "tombstone")


@query("replica_get", f"WITH {_REPLICAS} SELECT rv.node_id, rv.id, rv.hlc, rv.tombstone FROM rv JOIN (SELECT DISTINCT c_custkey AS id FROM customer) USING (id)")
def replica_get(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id")).distinct()
    return replica_versions(spark, sf_dir).join(asked, "id", "left_semi").select("node_id", "id", "hlc", "tombstone")


@query("get_by_ids", f"WITH {sql.LOG} SELECT o_orderkey AS pos, w.id, w.hlc, w.payload FROM orders JOIN {sql.winners('wlog')} w ON o_custkey = w.id WHERE NOT tombstone")
def get_by_ids(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("long").alias("id"))
    return lww.get_by_ids(asked, lww.winners(write_log(spark, sf_dir))).select("pos", "id", "hlc", "payload")


@query("stream_shard", f"WITH {_SHARDED} SELECT shard_idx, id, hlc, tombstone, CASE WHEN tombstone THEN '' ELSE payload END AS payload FROM {sql.winners('sw')}")
def stream_shard(spark, sf_dir):
    v = lww.winners(sharded_writes(spark, sf_dir))
    return v.select("shard_idx", "id", "hlc", "tombstone", F.when(F.col("tombstone"), F.lit("")).otherwise(F.col("payload")).alias("payload"))


@query(
    "shard_transfer",
    f"WITH {_REPLICAS} SELECT s.id, s.hlc, s.tombstone FROM rv s LEFT JOIN (SELECT * FROM rv WHERE node_id = 1) t ON t.id = s.id WHERE s.node_id = 0 AND (t.hlc IS NULL OR s.hlc > t.hlc)",
)
def shard_transfer(spark, sf_dir):
    v = replica_versions(spark, sf_dir)
    return lww.transfer(v.where("node_id = 0").drop("node_id"), v.where("node_id = 1").drop("node_id")).select("id", "hlc", "tombstone")


# Replication


_LEVELS = [(c, n) for c in ("ONE", "QUORUM", "ALL", "UNSPECIFIED") for n in range(7)]


@query(
    "consistency_count",
    f"WITH {sql.values('levels', 'level, n', _LEVELS)} SELECT level, n, greatest(1, least(CASE level WHEN 'ONE' THEN 1 WHEN 'ALL' THEN n ELSE n // 2 + 1 END, greatest(n, 1)))::INTEGER AS need FROM levels",
)
def consistency_count(spark, sf_dir):
    df = spark.createDataFrame(_LEVELS, "level string, n int")
    return df.select("level", "n", replication.consistency_count(F.col("level"), F.col("n")).alias("need"))


@query(
    "write_quorum_outcome",
    f"WITH {_SHARDED}, {_VIEW}, per AS (SELECT shard_idx, count(*) AS n, sum(up::INTEGER)::INTEGER AS acks FROM view_ GROUP BY 1) "
    "SELECT seq, id, shard_idx, acks, (n // 2 + 1)::INTEGER AS need, acks >= n // 2 + 1 AS ok FROM sw JOIN per USING (shard_idx)",
)
def write_quorum_outcome(spark, sf_dir):
    return replication.write_outcome(sharded_writes(spark, sf_dir), alpha_view(spark))


@query("hints_generated", f"WITH {_SHARDED}, {_VIEW} SELECT v.node_id::BIGINT AS target_node, w.shard_idx, w.seq, w.id, w.hlc, w.tombstone FROM sw w JOIN view_ v USING (shard_idx) WHERE NOT v.up")
def hints_generated(spark, sf_dir):
    return replication.hints(sharded_writes(spark, sf_dir), alpha_view(spark)).select("target_node", "shard_idx", "seq", "id", "hlc", "tombstone")


def _replayed(spark, sf_dir):
    writes = sharded_writes(spark, sf_dir).drop("node_id")
    reached = writes.join(F.broadcast(alpha_view(spark).where("up").select("shard_idx", "node_id")), "shard_idx")
    log = reached.select("node_id", "id", "seq", "hlc", "tombstone")
    return replication.replay(replication.hints(writes, alpha_view(spark)), log, nodes(spark))


@query(
    "hint_replay",
    f"WITH {_SHARDED}, {_VIEW}, got AS (SELECT v.node_id, w.id, w.seq, w.hlc, w.tombstone FROM sw w JOIN view_ v USING (shard_idx)) SELECT node_id::BIGINT AS node_id, id, hlc, tombstone FROM {sql.winners('got', 'node_id, id')}",
)
def hint_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)[0].select("node_id", "id", "hlc", "tombstone")


_RESPONSES = f"{_REPLICAS}, ids AS (SELECT DISTINCT id FROM wlog), up_(node_id) AS (VALUES (0), (2)), resp AS (SELECT u.node_id, i.id, r.hlc, r.tombstone FROM ids i, up_ u LEFT JOIN rv r ON r.node_id = u.node_id AND r.id = i.id)"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replicas 0 and 2 answer for every id; replica 1 is out of reach."""
    log = write_log(spark, sf_dir)
    asked = log.select("id").distinct().withColumn("node_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return asked.join(replica_versions(spark, sf_dir), ["node_id", "id"], "left")


@query(
    "read_quorum_get",
    f"WITH {_RESPONSES} SELECT id, hlc, tombstone, n AS responses, n >= 2 AS ok FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY hlc DESC NULLS LAST, node_id) AS rn FROM resp) WHERE rn = 1",
)
def read_quorum_get(spark, sf_dir):
    return replication.read_quorum(responses(spark, sf_dir), "QUORUM", 3)


@query(
    "read_repair_set",
    f"WITH {_RESPONSES} SELECT id, node_id::BIGINT AS node_id, hlc, winner_hlc FROM (SELECT *, max(hlc) OVER (PARTITION BY id) AS winner_hlc FROM resp) WHERE winner_hlc IS NOT NULL AND (hlc IS NULL OR hlc < winner_hlc)",
)
def read_repair_set(spark, sf_dir):
    return replication.read_repair(responses(spark, sf_dir))


@query(
    "search_routing",
    f"WITH {_MAP}, {_NODES} SELECT collection, shard_idx, node_id::BIGINT AS node_id, state FROM (SELECT m.*, row_number() OVER (PARTITION BY collection, shard_idx ORDER BY (state <> 'Active')::INTEGER, rank) AS rn FROM smap m JOIN nodes USING (node_id) WHERE up) WHERE rn = 1",
)
def search_routing(spark, sf_dir):
    return replication.search_routing(shard_map(spark), nodes(spark))


_HELD = (
    f"{sql.homes(COLLECTIONS)}, {sql.ring('r5', NODES)}, {sql.ring('r6', [*NODES, 6])}, {sql.placed('a', 'r5')}, {sql.placed('b', 'r6')}, {_STATES}, "
    "desired AS (SELECT b.collection, b.shard_idx, b.node_id, coalesce(s.state, 'Active') AS state FROM b LEFT JOIN states s USING (collection, shard_idx, node_id)), "
    "held AS (SELECT collection, shard_idx, node_id, CASE WHEN collection = 'alpha' THEN 10 ELSE 0 END AS points FROM a)"
)


@query(
    "reconcile_plan",
    f"WITH {_HELD}, aa AS (SELECT collection, shard_idx, min((state = 'Active')::INTEGER) AS all_active FROM desired GROUP BY 1, 2), "
    "j AS (SELECT coalesce(d.collection, h.collection) AS collection, coalesce(d.shard_idx, h.shard_idx) AS shard_idx, coalesce(d.node_id, h.node_id) AS node_id, d.state, h.points, d.node_id IS NOT NULL AS want "
    "FROM desired d FULL JOIN held h ON d.collection = h.collection AND d.shard_idx = h.shard_idx AND d.node_id = h.node_id) "
    "SELECT j.collection, j.shard_idx, j.node_id::BIGINT AS node_id, CASE WHEN NOT want THEN CASE WHEN all_active = 1 THEN 'drop' ELSE 'wait' END "
    "WHEN j.state = 'Active' AND coalesce(points, 0) > 0 THEN 'keep' "
    "WHEN NOT EXISTS (SELECT 1 FROM desired p WHERE p.collection = j.collection AND p.shard_idx = j.shard_idx AND p.node_id <> j.node_id AND p.state = 'Active') THEN 'activate' "
    "WHEN j.state = 'Active' AND NOT EXISTS (SELECT 1 FROM desired p JOIN held h2 USING (collection, shard_idx, node_id) WHERE p.collection = j.collection AND p.shard_idx = j.shard_idx AND p.state = 'Active' AND h2.points > 0) THEN 'keep' "
    "ELSE 'acquire' END AS action FROM j JOIN aa ON aa.collection = j.collection AND aa.shard_idx = j.shard_idx",
)
def reconcile_plan(spark, sf_dir):
    states = spark.createDataFrame(STATES, "collection string, shard_idx int, node_id long, state string")
    desired = placement.shard_map(placed(spark, [*NODES, 6]), states).select("collection", "shard_idx", "node_id", "state")
    held = placed(spark).select("collection", "shard_idx", "node_id", F.when(F.col("collection") == "alpha", 10).otherwise(0).alias("points"))
    return replication.reconcile_plan(desired, held, held)


@query("read_view", f"WITH {_MAP}, {_NODES} SELECT collection, shard_idx, rank::INTEGER AS rank, node_id::BIGINT AS node_id, up FROM smap JOIN nodes USING (node_id) WHERE state = 'Active'")
def read_view(spark, sf_dir):
    return replication.read_view(shard_map(spark), nodes(spark)).select("collection", "shard_idx", "rank", "node_id", "up")


@query(
    "replica_write",
    f"WITH {sql.LATE} SELECT node_id, seq, id, CASE WHEN hlc <= max(hlc) OVER (PARTITION BY node_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'Stale' ELSE 'Applied' END AS outcome FROM late",
)
def replica_write(spark, sf_dir):
    """What each replica says to the writes that reach it."""
    return lww.outcomes(late_log(spark, sf_dir), ("node_id", "id")).select("node_id", "seq", "id", "outcome")


def _moves() -> list[tuple[int, int, int]]:
    """(shard_idx, source, target): replica 1 pulls the even shards from 0, and 0 the odd ones from 2."""
    return [(i, 0, 1) if i % 2 == 0 else (i, 2, 0) for i in range(SHARDS)]


@query(
    "rebalance_pull",
    f"WITH {_REPLICAS}, {sql.hashed('SELECT DISTINCT id FROM rv')}, v AS (SELECT rv.*, (h % 8)::INTEGER AS shard_idx FROM rv JOIN h USING (id)), {sql.values('moves', 'shard_idx, source, target', _moves())} "
    "SELECT m.target::BIGINT AS node_id, v.shard_idx, v.id, v.hlc, v.tombstone FROM v JOIN moves m ON m.shard_idx = v.shard_idx AND m.source = v.node_id LEFT JOIN v t ON t.node_id = m.target AND t.id = v.id WHERE t.hlc IS NULL OR v.hlc > t.hlc",
)
def rebalance_pull(spark, sf_dir):
    v = replica_versions(spark, sf_dir).withColumn("shard_idx", placement.shard_for_id(F.col("id"), SHARDS))
    return rebalance.pull(v, spark.createDataFrame(_moves(), "shard_idx int, source long, target long")).select("node_id", "shard_idx", "id", "hlc", "tombstone")


# Metadata, durability, streaming


_META = [
    *[("register", {"node_id": n, "addr": f"node{n}:7000"}) for n in NODES],
    ("create", {"name": "alpha", "schema": meta.Schema(64)}),
    ("create", {"name": "alpha", "schema": meta.Schema(3)}),
    ("create", {"name": "gone", "schema": meta.Schema(8)}),
    ("set_state", {"collection": "gone", "shard_idx": 0, "node_id": 1, "state": "Syncing"}),
    ("drop", {"name": "gone"}),
    ("create", {"name": "beta", "schema": meta.Schema(64, "COSINE", 4, 3)}),
    *[("set_state", {"collection": c, "shard_idx": i, "node_id": n, "state": s}) for c, i, n, s in STATES],
    ("noop", {}),
]


@query("meta_fold", f"WITH {_MAP} SELECT collection, shard_idx, rank::INTEGER AS rank, node_id::BIGINT AS node_id, state FROM smap")
def meta_fold(spark, sf_dir):
    return meta.fold(_META).shard_map(spark)


@query("snapshot_tail_replay", f"WITH {sql.LATE} SELECT id, seq, hlc, tombstone FROM {sql.winners('late')}")
def snapshot_tail_replay(spark, sf_dir):
    """A snapshot of the first half of the arrivals and the log after it, which must equal the whole log's winners."""
    log = late_log(spark, sf_dir).select("id", "seq", "hlc", "tombstone")
    n = log.count()
    path = files.shared_path(spark, "snapshot")
    lww.winners(log.where(F.col("seq") < n // 2)).write.parquet(path)
    return lww.winners(spark.read.schema(log.schema).parquet(path).unionByName(log.where(F.col("seq") >= n // 2)))


@query("store_recovery", f"WITH {sql.LATE} SELECT id, hlc, tombstone FROM {sql.winners('late')}")
def store_recovery(spark, sf_dir):
    """Batches of the log in a collection on disk, a snapshot after the second, read by another Store."""
    log = late_log(spark, sf_dir).select("id", F.array(F.lit(1.0)).alias("vector"), F.col("payload").cast("binary").alias("payload"), "hlc", "tombstone", "seq")
    root = files.shared_path(spark, "store")
    store = Store(spark, root)
    store.create("c", meta.Schema(1))
    for k in range(3):
        store.append("c", log.where(F.col("seq") % 3 == k), k)
        if k == 1:
            store.snapshot("c")
    return Store(spark, root).versions("c").select("id", "hlc", "tombstone")


_SYNCED = [x for x in STATES if x[:3] != ("alpha", 4, 5)]


@query("meta_log_recovery", f"WITH {_PLACED}, {sql.values('states', 'collection, shard_idx, node_id, state', _SYNCED)} SELECT p.collection, p.shard_idx, p.rank::INTEGER AS rank, p.node_id::BIGINT AS node_id, coalesce(s.state, 'Active') AS state FROM placed p LEFT JOIN states s USING (collection, shard_idx, node_id)")
def meta_log_recovery(spark, sf_dir):
    """The metadata log with a node that leaves and a state that is reset, folded again from its snapshots and requests."""
    folder = files.shared_path(spark, "meta")
    log = MetaLog(spark, folder, snapshot_every=8)
    for kind, args in [("register", {"node_id": 6, "addr": "node6:7000"}), *_META, ("set_state", {"collection": "alpha", "shard_idx": 1, "node_id": 6, "state": "Syncing"}), ("deregister", {"node_id": 6}), ("set_state", {"collection": "alpha", "shard_idx": 4, "node_id": 5, "state": "Active"})]:
        log.apply(kind, **args)
    return MetaLog(spark, folder).state.shard_map(spark)


@query(
    "wal_scan",
    f"WITH {sql.LOG} SELECT CASE WHEN tombstone THEN 'delete' ELSE 'upsert' END AS op, hlc, id, CASE WHEN tombstone THEN 0 ELSE 3 END::INTEGER AS dim, CASE WHEN tombstone THEN 0 ELSE octet_length(encode(payload)) END::INTEGER AS payload_bytes FROM wlog",
)
def wal_scan(spark, sf_dir):
    log = write_log(spark, sf_dir).select(F.when(F.col("tombstone"), "delete").otherwise("upsert").alias("op"), "hlc", "id", F.array(*[F.lit(x).cast("float") for x in (1.0, 2.0, 3.0)]).alias("vector"), F.encode("payload", "utf-8").alias("payload"))
    folder = files.shared_path(spark, "wal")
    manifest = files.shared_path(spark, "wal-manifest")
    wal.write(log, folder).write.parquet(manifest)
    return wal.scan(spark, spark.read.parquet(manifest)).select("op", "hlc", "id", F.size("vector").alias("dim"), F.octet_length("payload").alias("payload_bytes"))


@query("stream_lww", f"WITH {sql.LATE} SELECT id, seq, hlc, tombstone FROM {sql.winners('late')}")
def stream_lww(spark, sf_dir):
    base = files.shared_path(spark, "stream")
    log = late_log(spark, sf_dir).select("seq", "id", "hlc", "tombstone")
    log.repartition(4).write.parquet(f"{base}/log")
    q = stream.materialise(stream.latest(stream.read_log(spark, f"{base}/log", log.schema)), f"{base}/state", f"{base}/checkpoint")
    q.awaitTermination()
    return stream.current(spark, f"{base}/state").select("id", "seq", "hlc", "tombstone")


@query(
    "stream_outcomes",
    f"WITH {sql.LATE} SELECT seq, id, CASE WHEN hlc <= max(hlc) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'Stale' ELSE 'Applied' END AS outcome FROM late",
)
def stream_outcomes(spark, sf_dir):
    base = files.shared_path(spark, "stream")
    log = late_log(spark, sf_dir).select("seq", "id", "hlc")
    n = log.count()
    for k in range(3):  # arrivals in order, a file at a time
        log.where((F.col("seq") >= k * n // 3) & (F.col("seq") < (k + 1) * n // 3)).coalesce(1).write.mode("append").parquet(f"{base}/log")
    q = stream.append(stream.outcomes(stream.read_log(spark, f"{base}/log", log.schema)), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.schema("seq long, id long, outcome string").parquet(f"{base}/out")
