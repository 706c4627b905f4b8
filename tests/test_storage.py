import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.client import Client
from meridian.config import Config
from meridian.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, Unavailable
from meridian.functions.hlc import Clock
from meridian.operators import hnsw, knn
from meridian.operators.meta import Schema
from meridian.sources import files, hints, wal
from meridian.sources.meta_log import MetaLog
from meridian.sources.store import Store

GOLDEN = "2900000090f77d8b0000000100000000000a00000000000000030000000000803f000000400000404000000000"


def frames():
    return [wal.encode(wal.UPSERT, 65536, 10, [1, 2, 3]), wal.encode(wal.DELETE, 65537, 10), wal.encode(wal.UPSERT, 65538, 11, [0.5], b"\t\t")]


def test_wal_golden():
    assert frames()[0].hex() == GOLDEN
    assert [r[2:] for r in wal.decode(b"".join(frames()))] == [("upsert", 65536, 10, [1.0, 2.0, 3.0], b""), ("delete", 65537, 10, [], b""), ("upsert", 65538, 11, [0.5], b"\t\t")]


def test_wal_cut_anywhere():
    blob = b"".join(frames())
    ends = np.cumsum([len(f) for f in frames()]).tolist()
    for n in range(len(blob) + 1):
        assert len(list(wal.decode(blob[:n]))) == sum(e <= n for e in ends)
        assert wal.good_end(blob[:n]) == max([e for e in ends if e <= n], default=0)


def test_wal_flipped_bytes():
    blob = b"".join(frames())
    first = len(frames()[0])
    for i in range(len(blob)):
        bad = blob[:i] + bytes([blob[i] ^ 0xFF]) + blob[i + 1 :]
        assert len(list(wal.decode(bad))) == (0 if i < first else 1 if i < first + len(frames()[1]) else 2)
    body = struct.pack("<BQQI", 7, 1, 1, 0) + struct.pack("<I", 0)
    import zlib

    assert list(wal.decode(struct.pack("<II", len(body) + 4, zlib.crc32(body)) + body)) == []


def test_wal_source(spark):
    folder = files.shared_path(spark, "wal-test")
    log = spark.createDataFrame([("upsert", i, i, [float(i)], bytearray(b"p")) if i % 3 else ("delete", i, i, None, None) for i in range(50)], "op string, hlc long, id long, vector array<float>, payload binary")
    assert wal.write(log.repartition(3), folder, segment_records=10).groupBy().sum("records").first()[0] == 50
    spark.dataSource.register(wal.WalSource)
    a = wal.scan(spark, folder).drop("file")
    b = spark.read.format("meridian_wal").load(folder)
    rows = lambda df: sorted((r["hlc"], r["op"], r["id"], tuple(r["vector"])) for r in df.collect())
    assert rows(a) == rows(b) and len(rows(a)) == 50 and rows(a)[4] == (4, "upsert", 4, (4.0,))


def test_hint_frames():
    rows = [(3, "a/é", 7, wal.UPSERT, 9, 1, [1.0], b"x"), (4, "", 0, wal.DELETE, 10, 2)]
    blob = b"".join(hints.encode(*r) for r in rows)
    want = [(3, "a/é", 7, "upsert", 9, 1, [1.0], b"x"), (4, "", 0, "delete", 10, 2, [], b"")]
    assert list(hints.decode(blob)) == want
    first = len(hints.encode(*rows[0]))
    for n in range(len(blob)):
        assert list(hints.decode(blob[:n])) == want[: int(n >= first)]
    for i in range(first):
        assert list(hints.decode(blob[:i] + bytes([blob[i] ^ 1]) + blob[i + 1 :])) == []


def test_hint_table(spark):
    t = hints.HintTable(spark, files.shared_path(spark, "hints"))
    rows = [(n, "c", 0, "delete" if i == 2 else "upsert", 10 + i, i, None, None) for n in (1, 2) for i in range(3)]
    t.append(spark.createDataFrame(rows[:3], hints.SCHEMA))
    t.append(spark.createDataFrame(rows[3:], hints.SCHEMA))
    assert t.read().count() == 6
    log = spark.createDataFrame([(1, 0, 5, 99, False), (1, 2, 6, 11, False)], "node_id long, id long, seq long, hlc long, tombstone boolean")
    state = t.replay(log, spark.createDataFrame([(1,)], "node_id long"))
    assert sorted((r["id"], r["hlc"], r["tombstone"]) for r in state.collect()) == [(0, 99, False), (1, 11, False), (2, 12, True)]
    assert {r["target_node"] for r in t.read().collect()} == {2} and t.read().count() == 3
    t.clear()
    assert t.read().count() == 0


def test_meta_log(spark):
    folder = files.shared_path(spark, "meta")
    log = MetaLog(spark, folder, snapshot_every=3)
    log.apply("register", node_id=1, addr="h:1")
    assert log.apply("create", name="a", schema=Schema(4)) == "created" and log.apply("create", name="a", schema=Schema(5)) == "exists"
    log.apply("set_state", collection="a", shard_idx=0, node_id=1, state="Syncing")
    other = MetaLog(spark, folder)
    assert other.state == log.state and other.index == 4 and other.state.collections["a"].dim == 4
    other.apply("noop")
    with pytest.raises(RuntimeError):
        log.apply("noop")


def test_config():
    c = Config.from_toml('node_id = 3\nlisten_addr = "127.0.0.1:1"\nvnodes = 8\n[raft]\npeers = []\n')
    assert (c.node_id, c.vnodes, c.advertise, c.snapshot_wal_mb) == (3, 8, "127.0.0.1:1", 128)
    assert Config.from_flags(["--node-id", "2", "--advertise-addr", "db:7"]).advertise == "db:7"
    for bad in ("node_id = 1\nvnodes = 0", "node_id = 1\nsnapshot_wal_mb = 0"):
        with pytest.raises(ValueError):
            Config.from_toml(bad)


@pytest.fixture
def client(spark):
    ticks = iter(range(1, 10**6))
    return Client(spark, files.shared_path(spark, "store"), clock=Clock(lambda: next(ticks)))


def test_client(client, spark):
    client.create_collection("a/b.c", 2)
    with pytest.raises(AlreadyExists):
        client.create_collection("a/b.c", 3)
    for bad in (("", 2, "L2"), ("x", 0, "L2"), ("x", 2, "DOT")):
        with pytest.raises(InvalidArgument):
            client.create_collection(*bad)
    assert client.upsert("a/b.c", [(1, [0, 0], b"one"), (2, [3, 4]), (3, [1, 0], b""), (2, [0, 5], b"two")]) == 4
    assert client.get("a/b.c", [2, 9, 1, 2]) == [(2, [0.0, 5.0], b"two"), (1, [0.0, 0.0], b"one"), (2, [0.0, 5.0], b"two")]
    assert [(i, s) for i, s, _ in client.search("a/b.c", [0, 0], 2)] == [(1, 0.0), (3, 1.0)]
    assert [(i, s) for i, s, _ in client.search("a/b.c", [0, 0], exact=False)] == [(1, 0.0), (3, 1.0), (2, 25.0)]
    assert client.delete("a/b.c", [1, 77]) == 2
    assert client.get("a/b.c", [1]) == [] and [i for i, _, _ in client.search("a/b.c", [0, 0])] == [3, 2]
    client.store.snapshot("a/b.c")
    client.upsert("a/b.c", [(1, [9, 9])])
    assert client.get("a/b.c", [1, 3]) == [(1, [9.0, 9.0], None), (3, [1.0, 0.0], b"")]
    for points in ([(1, [1])], [(-1, [1, 1])], spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), spark.createDataFrame([(1, [1.0, float("nan")])], "id long, vector array<float>")):
        with pytest.raises(InvalidArgument):
            client.upsert("a/b.c", points)
    with pytest.raises(InvalidArgument):
        client.search("a/b.c", [1])
    with pytest.raises(NotFound):
        client.upsert("none", [])


def test_dropped_data_stays_gone(client):
    client.create_collection("c", 1)
    client.upsert("c", [(1, [1])])
    client.drop_collection("c")
    with pytest.raises(NotFound):
        client.drop_collection("c")
    client.create_collection("c", 1, "COSINE", 3)
    assert client.get("c", [1]) == [] and client.store.schema("c").shard_count == 3


def test_a_new_client_goes_on(client, spark):
    client.create_collection("c", 1)
    client.upsert("c", [(1, [1])])
    other = Client(spark, client.store.root, clock=Clock(lambda: 0))
    other.upsert("c", [(1, [2])])
    assert other.get("c", [1])[0][1] == [2.0]


def test_snapshots_by_size(spark):
    with pytest.raises(ValueError):
        Store(spark, "file:///tmp/x", 0)
    store, g = Store(spark, files.shared_path(spark, "store"), 1), np.random.default_rng(1)
    store.create("s", Schema(64))
    for n in range(4):
        rows = [(i, [float(x) for x in g.normal(size=64)], None, n * 1000 + i, False, i) for i in range(n * 500, n * 500 + 1500)]
        store.append("s", spark.createDataFrame(rows, "id long, vector array<float>, payload binary, hlc long, tombstone boolean, seq long"), n)
    m = store.manifest("s")
    assert m["snapshot"]["lsn"] >= 3 and len(m["batches"]) < 3 and store.versions("s").count() == 3000


def test_membership(client):
    client.join("2@h:1")
    assert client.cluster_info()["nodes"][2] == "h:1" and client.health() == "ok"
    client.leave(2)
    with pytest.raises(FailedPrecondition):
        client.leave(1)
    with pytest.raises(InvalidArgument):
        client.join("zz")


def test_random_program(client):
    """Random upserts and deletes against a dictionary."""
    r, model = random.Random(4), {}
    client.create_collection("p", 2)
    for _ in range(6):
        points = [(r.randrange(20), [r.randrange(9), r.randrange(9)]) for _ in range(8)]
        client.upsert("p", points)
        model.update({i: [float(x) for x in v] for i, v in points})
        gone = [r.randrange(20) for _ in range(3)]
        client.delete("p", gone)
        for i in gone:
            model.pop(i, None)
    assert {i: v for i, v, _ in client.get("p", range(20))} == model
    want = sorted((sum((a - 4) ** 2 for a in v), i) for i, v in model.items())[:5]
    assert [(s, i) for i, s, _ in client.search("p", [4, 4], 5)] == want


def clustered(n, dim, seed):
    g = np.random.default_rng(seed)
    centers = g.uniform(-1, 1, (50, dim))
    return centers[g.integers(0, 50, n)] + g.normal(0, 0.35, (n, dim))


@pytest.mark.parametrize("metric", ["L2", "COSINE"])
def test_graph_recall(metric):
    data, queries = clustered(2000, 16, 1), clustered(50, 16, 2)
    g = hnsw.Graph(np.arange(2000) * 3, data, metric, hnsw.Params(ef_construction=100))
    assert g.violations() == []
    same = hnsw.Graph.from_bytes(g.to_bytes())
    hits = 0
    for q in queries:
        found = g.search(q, 10, 64)
        assert found == same.search(q, 10, 64) and found == sorted(found) and len(found) == 10
        d = ((data - q) ** 2).sum(axis=1) if metric == "L2" else 1 - data @ q / np.linalg.norm(data, axis=1) / np.linalg.norm(q)
        hits += len({i for _, i in found} & set((np.argsort(d)[:10] * 3).tolist()))
    assert hits >= 0.95 * 500


def test_recall_of_a_large_graph():
    """10,000 clustered points of 128 dimensions, ef_construction 200, ef 64, 100 queries: far more points than ef."""
    g = np.random.default_rng(7)
    centers = g.uniform(-1, 1, (50, 128))
    data, queries = (centers[g.integers(0, 50, n)] + g.normal(0, 0.35, (n, 128)) for n in (10_000, 100))
    graph = hnsw.Graph(np.arange(10_000), data)
    assert graph.violations() == []
    hits = 0
    for q in queries:
        exact = np.argsort(((data - q) ** 2).sum(axis=1))[:10]
        hits += len({i for _, i in graph.search(q, 10, 64)} & set(exact.tolist()))
    assert hits >= 0.95 * 1000


def test_kept_graphs(client, spark):
    r = random.Random(6)
    client.create_collection("g", 4, shard_count=3)
    client.upsert("g", [(i, [r.random() for _ in range(4)]) for i in range(300)])
    q = [0.5] * 4
    same = lambda k: [x[:2] for x in client.search("g", q, k, 300, exact=False)] == [x[:2] for x in client.search("g", q, k)]
    assert client.store.graphs("g") is None and same(10)
    path = client.store.manifest("g")["graphs"]["path"]
    best = client.search("g", q, 3)
    client.delete("g", [best[0][0]])
    client.upsert("g", [(best[1][0], [9, 9, 9, 9]), (1000, q, b"new")])
    assert same(10) and client.search("g", q, 1, exact=False) == [(1000, 0.0, b"new")]
    assert client.store.manifest("g")["graphs"]["path"] == path
    other = Client(spark, client.store.root)
    assert [x[:2] for x in other.search("g", q, 10, 300, exact=False)] == [x[:2] for x in client.search("g", q, 10)]
    client.store.snapshot("g")
    assert client.store.manifest("g")["graphs"]["path"] != path and same(10)


def test_a_restart_keeps_metadata(client, spark):
    client.join("2@h:2")
    client.join("3@h:3")
    client.create_collection("alpha", 2, replication_n=2)
    client.create_collection("beta", 2, "COSINE", 4)
    client.set_state("alpha", 0, client.meta.shard_rows()[0][3], "Syncing")
    client.leave(3)
    client.create_collection("gone", 2)
    client.drop_collection("gone")
    client.upsert("alpha", [(1, [1, 2], b"x")])
    other = Client(spark, client.store.root, node=(9, "h:9"))
    assert other.cluster_info() == client.cluster_info() and set(other.meta.nodes) == {1, 2} and set(other.meta.collections) == {"alpha", "beta"}
    assert other.get("alpha", [1], "ONE") == [(1, [1.0, 2.0], b"x")] and other.search("beta", [1, 1]) == []


def test_consistency_and_hints(client):
    for n in (2, 3):
        client.join(f"{n}@h:{n}")
    client.create_collection("c", 1, shard_count=1, replication_n=3)
    client.mark(2, up=False)
    assert client.upsert("c", [(1, [1]), (2, [2])]) == 2 and client.get("c", [1])[0][0] == 1
    with pytest.raises(Unavailable):
        client.upsert("c", [(3, [3])], "ALL")
    with pytest.raises(Unavailable):
        client.get("c", [1], "ALL")
    client.mark(3, up=False)
    with pytest.raises(Unavailable):
        client.delete("c", [1])
    assert client.delete("c", [2], "ONE") == 1
    with pytest.raises(InvalidArgument):
        client.get("c", [1], "MOST")
    assert client.mark(2, up=True) == 5 and client.mark(2, up=True) == 0
    assert [x[0] for x in client.get("c", [1, 2, 3], "QUORUM")] == [3]  # a missed quorum takes nothing back
    assert client.mark(3, up=True) == 2 and client.get("c", [3], "ALL")[0][1] == [3.0]
    client.set_state("c", 0, 1, "Syncing")
    with pytest.raises(Unavailable):
        client.get("c", [3], "ALL")


def test_upserts_of_frames(client, spark):
    client.create_collection("f", 1)
    assert client.upsert("f", spark.range(50).selectExpr("id", "array(cast(id as float)) as vector")) == 50
    assert client.delete("f", spark.range(49).select("id")) == 49 and [i for i, _, _ in client.search("f", [0])] == [49]


def test_only_segments_of_the_manifest_count(spark, tmp_path):
    """Segments of attempts that didn't count are not read; a segment is bounded in bytes and read frame by frame."""
    folder = f"file://{tmp_path}/wal"
    log = spark.createDataFrame([("upsert", i, i, [1.0] * 8, bytearray(100)) for i in range(200)], "op string, hlc long, id long, vector array<float>, payload binary").coalesce(2)
    manifest = wal.write(log, folder, segment_bytes=2000)
    manifest.write.parquet(f"file://{tmp_path}/m1")
    manifest.write.parquet(f"file://{tmp_path}/m2")
    paths = spark.read.parquet(f"file://{tmp_path}/m1")
    assert paths.count() > 10 and all(r["records"] <= 15 for r in paths.collect())
    assert sorted(r["id"] for r in wal.scan(spark, paths).collect()) == list(range(200))
    assert wal.scan(spark, folder).count() == 400
    with open(paths.first()["path"].removeprefix("file://"), "r+b") as f:
        f.truncate(300)
    assert wal.scan(spark, paths).count() == 200 - paths.first()["records"] + 1


def test_graph_edges():
    assert hnsw.Graph(np.zeros(0, np.int64), np.zeros((0, 2))).search([1, 1], 3, 10) == []
    one = hnsw.Graph(np.array([5]), np.array([[1.0, 1.0]]))
    assert one.search([0, 0], 3, 10) == [(2.0, 5)] and one.search([0, 0], 0, 10) == []
    with pytest.raises(ValueError):
        hnsw.Params(m=1)


def test_knn_edges(spark):
    df = spark.createDataFrame([(2, [1.0]), (1, [1.0]), (3, [0.0])], "id long, vector array<float>")
    assert [(r["id"], r["score"]) for r in knn.knn(df, [0.0], 10).collect()] == [(3, 0.0), (1, 1.0), (2, 1.0)]
    assert knn.knn(df, [0.0], 0).count() == 0 and knn.knn(df.limit(0), [0.0], 5).count() == 0
    plan = knn.knn(df, [0.0], 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    topk = knn.shard_topk(df.withColumn("shard_idx", (F.col("id") % 2).cast("int")), [0.0], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in topk


@pytest.mark.parametrize("metric", ["L2", "COSINE"])
def test_batch_search_equals_single(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    data = clustered(300, 8, 5).astype(np.float32)
    data[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>").repartition(3)
    queries = df.where("id % 40 = 7").selectExpr("id as qid", "vector as qvector")
    got = knn.knn_join(queries, df, 5, metric).collect()
    for q in queries.collect():
        want = [(r["id"], r["score"]) for r in knn.knn(df, list(q["qvector"]), 5, metric).collect()]
        assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q["qid"]] == want
    assert knn.knn_join(queries.limit(0), df).count() == 0
