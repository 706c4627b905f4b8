import random

import pytest

from meridian.errors import FailedPrecondition
from meridian.operators import lww, meta, placement, rebalance, replication


def replay(writes):
    """The accept rule, one write at a time."""
    have, out = {}, []
    for seq, id_, hlc, dead in sorted(writes):
        ok = id_ not in have or hlc > have[id_][1]
        out.append((seq, "Applied" if ok else "Stale"))
        if ok:
            have[id_] = (seq, hlc, dead)
    return have, out


def frame(spark, writes):
    return spark.createDataFrame(writes, "seq long, id long, hlc long, tombstone boolean")


@pytest.mark.parametrize("writes", [[(0, 1, 10, False), (1, 1, 5, False), (2, 1, 20, False), (3, 1, 20, False)], [(0, 1, 10, False), (1, 1, 20, True), (2, 1, 15, False), (3, 1, 30, False)], None])
def test_lww_against_replay(spark, writes):
    if writes is None:
        r = random.Random(3)
        writes = [(i, r.randrange(30), r.randrange(40), r.random() < 0.25) for i in range(1500)]
        r.shuffle(writes)
    have, out = replay(writes)
    df = frame(spark, writes)
    assert sorted((r["id"], r["seq"], r["hlc"], r["tombstone"]) for r in lww.winners(df).collect()) == sorted((i, *v) for i, v in have.items())
    assert sorted((r["seq"], r["outcome"]) for r in lww.outcomes(df).collect()) == sorted(out)


def test_known_outcomes(spark):
    df = frame(spark, [(0, 1, 10, False), (1, 1, 5, False), (2, 1, 20, False), (3, 1, 20, False)])
    assert [r["outcome"] for r in lww.outcomes(df).orderBy("seq").collect()] == ["Applied", "Stale", "Applied", "Stale"]


def test_get_keeps_order_and_repeats(spark):
    v = frame(spark, [(0, 1, 1, False), (1, 2, 2, True), (2, 3, 3, False)])
    asked = spark.createDataFrame(list(enumerate([3, 1, 9, 2, 3])), "pos long, id long")
    assert [r["id"] for r in lww.get_by_ids(asked, v).orderBy("pos").collect()] == [3, 1, 3]


def test_transfer_needs_strictly_higher(spark):
    a = frame(spark, [(0, 1, 5, False), (1, 2, 5, False), (2, 3, 5, True)])
    b = frame(spark, [(0, 1, 5, False), (1, 2, 4, False)])
    assert sorted(r["id"] for r in lww.transfer(a, b).collect()) == [2, 3]


def test_shards():
    assert [placement.shard_of(i, 8) for i in range(16)] == [3, 5, 0, 1, 3, 5, 3, 5, 6, 4, 2, 7, 1, 3, 2, 0]


def test_shard_balance(spark):
    from pyspark.sql import functions as F

    counts = [r["points"] for r in placement.shard_histogram(spark.range(100_000).select(F.col("id")), 8).collect()]
    assert len(counts) == 8 and all(10_000 < c < 15_000 for c in counts)


def test_ring(spark):
    want = [[2, 1, 4], [2, 5, 4], [1, 4, 5], [2, 1, 4], [4, 5, 1], [2, 4, 1], [5, 2, 3], [5, 2, 3]]
    assert [placement.replicas(range(1, 6), "vectors", s, 3) for s in range(8)] == want
    rows = placement.ring_replicas(placement.ring_frame(spark, range(1, 6)), placement.homes_frame(spark, [("vectors", 8, 3)])).orderBy("shard_idx", "rank").collect()
    assert [[r["node_id"] for r in rows[3 * s : 3 * s + 3]] for s in range(8)] == want
    assert placement.replicas([4, 9], "c", 0, 3) in ([4, 9], [9, 4]) and placement.replicas([], "c", 0, 3) == []
    with pytest.raises(ValueError):
        placement.ring([1], 0)


def test_ring_movement():
    before, after = ([placement.replicas(range(1, n), "c", s, 1)[0] for s in range(64)] for n in (4, 5))
    assert sum(a != b for a, b in zip(before, after, strict=True)) == 16


def test_metadata():
    m = meta.fold([("register", {"node_id": n, "addr": f"h{n}:1"}) for n in range(1, 6)] + [("create", {"name": "a", "schema": meta.Schema(64)})])
    assert len(m.shard_rows()) == 24 and m.apply("create", name="a", schema=meta.Schema(2)) == "exists" and m.collections["a"].dim == 64
    m.apply("set_state", collection="a", shard_idx=0, node_id=1, state="Syncing")
    assert m.state_of("a", 0, 1) == "Syncing" and meta.MetaState.from_json(m.to_json()) == m
    m.apply("deregister", node_id=1)
    assert m.state_of("a", 0, 1) == "Active" and all(r[3] != 1 for r in m.shard_rows())
    m.apply("set_state", collection="a", shard_idx=0, node_id=2, state="Syncing")
    assert m.apply("drop", name="a") == "dropped" and m.apply("drop", name="a") == "absent" and not m.states
    with pytest.raises(FailedPrecondition):
        m.leave(77)
    for n in (2, 3, 4):
        m.leave(n)
    with pytest.raises(FailedPrecondition):
        m.leave(5)
    assert meta.parse_target("3@host:70") == (3, "host:70")
    for bad in ("", "3", "x@h:1", "3@h", "3@:1", "3@h:x", "3@h:0"):
        with pytest.raises(ValueError):
            meta.parse_target(bad)


def test_hints_stay_for_unknown_targets(spark):
    hinted = spark.createDataFrame([(1, 0, 7, 5, False), (9, 0, 7, 5, False)], "target_node long, seq long, id long, hlc long, tombstone boolean")
    log = spark.createDataFrame([(1, 0, 7, 4, True)], "node_id long, seq long, id long, hlc long, tombstone boolean")
    nodes = spark.createDataFrame([(1,)], "node_id long")
    state, left = replication.replay(hinted, log, nodes)
    assert [(r["node_id"], r["hlc"], r["tombstone"]) for r in state.collect()] == [(1, 5, False)]
    assert [r["target_node"] for r in left.collect()] == [9]


def test_acquisitions(spark):
    plan = spark.createDataFrame([("c", 0, 1, "acquire"), ("c", 1, 1, "acquire"), ("c", 2, 1, "activate"), ("c", 3, 1, "keep")], "collection string, shard_idx int, node_id long, action string")
    sources = spark.createDataFrame([("c", 0, False), ("c", 0, True), ("c", 1, False)], "collection string, shard_idx int, ok boolean")
    got = sorted((r["shard_idx"], r["step"], r["state"]) for r in rebalance.transitions(plan, sources).collect())
    assert got == [(0, 0, "Syncing"), (0, 1, "Active"), (1, 0, "Syncing"), (2, 0, "Active")]


def test_replicas_agree_after_a_pull(spark):
    v = spark.createDataFrame([(1, 0, 7, 5, False), (1, 0, 8, 2, False), (2, 0, 7, 6, True), (2, 0, 9, 1, False)], "node_id long, shard_idx int, id long, hlc long, tombstone boolean")
    moves = spark.createDataFrame([(0, 2, 1)], "shard_idx int, source long, target long")
    got = rebalance.after_pull(v, rebalance.pull(v, moves)).where("node_id = 1")
    assert sorted((r["id"], r["hlc"], r["tombstone"]) for r in got.collect()) == [(7, 6, True), (8, 2, False), (9, 1, False)]
