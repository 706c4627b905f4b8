from meridian.sources import files
from meridian.streaming import lww as stream

DDL = "seq long, id long, hlc long, tombstone boolean"


def test_state_goes_on_after_a_restart(spark):
    base = files.shared_path(spark, "stream-test")
    rows = [(0, 1, 10, False), (1, 2, 5, False), (2, 1, 20, True), (3, 1, 15, False), (4, 2, 5, True), (5, 3, 1, False)]
    for part in (rows[:3], rows[3:]):
        df = spark.createDataFrame(part, DDL)
        df.coalesce(1).write.mode("append").parquet(f"{base}/log")
        stream.materialise(stream.latest(stream.read_log(spark, f"{base}/log", df.schema)), f"{base}/state", f"{base}/ckpt").awaitTermination()
        stream.append(stream.outcomes(stream.read_log(spark, f"{base}/log", df.schema)), f"{base}/out", f"{base}/ckpt2").awaitTermination()
    got = sorted((r["id"], r["seq"], r["hlc"], r["tombstone"]) for r in stream.current(spark, f"{base}/state").collect())
    assert got == [(1, 2, 20, True), (2, 1, 5, False), (3, 5, 1, False)]
    out = {r["seq"]: r["outcome"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert out == {0: "Applied", 1: "Applied", 2: "Applied", 3: "Stale", 4: "Stale", 5: "Applied"}


def test_changes_are_merged(spark):
    base = files.shared_path(spark, "stream-test")
    for n in range(5):
        spark.createDataFrame([(n, n % 2, 10 + n, n == 3)], DDL).coalesce(1).write.mode("append").parquet(f"{base}/log")
        schema = spark.read.parquet(f"{base}/log").schema
        stream.materialise(stream.latest(stream.read_log(spark, f"{base}/log", schema)), f"{base}/state", f"{base}/ckpt", merge_every=2).awaitTermination()
    assert files.names(spark, f"{base}/state") == ["base=3", "delta=4"]
    assert sorted((r["id"], r["hlc"], r["tombstone"]) for r in stream.current(spark, f"{base}/state").collect()) == [(0, 14, False), (1, 13, True)]
    assert stream.current(spark, f"{base}/none").count() == 0
