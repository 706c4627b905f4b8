import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meridian.functions import hlc
from meridian.functions.vector import DimensionError, check_vector, cosine_distance, distance, l2_squared
from meridian.functions.xxhash import unsigned_mod, xxh64, xxh64_column


def test_kernels(spark):
    rows = [([0.0, 0.0, 3.0], [0.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 2.0, 2.0], [2.0, 4.0, 4.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    for a, b, dim in (("a", "b", 3), ("a", "b", None), (a, b, 3)):
        got = df.select(l2_squared(a, b, dim).alias("l"), cosine_distance(a, b, dim).alias("c")).collect()
        assert [r["l"] for r in got] == [9.0, 2.0, 9.0, 4.0]
        assert [r["c"] for r in got] == [1.0, 1.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        distance("DOT", a, b)


def test_unrolled_equals_fold(spark):
    r = random.Random(1)
    rows = [([r.uniform(-1, 1) for _ in range(20)], [r.uniform(-1, 1) for _ in range(20)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    for f in (l2_squared, cosine_distance):
        assert df.where(f("a", "b", 20) != f(a, b)).count() == 0
        q = [float(np.float32(x)) for x in rows[0][1]]
        assert df.where(f("a", q, 20) != f("a", q)).count() == 0


def test_vectors_are_checked():
    assert check_vector([1, 2], 2) == [1.0, 2.0]
    with pytest.raises(DimensionError):
        check_vector([1.0], 2)
    for x in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            check_vector([x], 1)


def test_hash(spark):
    r = random.Random(2)
    for n in (0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 100):
        data = r.randbytes(n)
        assert xxh64(data) == xxhash.xxh64_intdigest(data)
    ids = [0, 1, 2**63 - 1, *(r.randrange(2**62) for _ in range(200))]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for row in df.select("id", *[unsigned_mod(xxh64_column(F.col("id")), n).alias(f"m{n}") for n in (1, 3, 7, 8, 1000)]).collect():
        h = xxhash.xxh64_intdigest(row["id"].to_bytes(8, "little"))
        assert [row[f"m{n}"] for n in (1, 3, 7, 8, 1000)] == [h % n for n in (1, 3, 7, 8, 1000)]
    raw = spark.createDataFrame([(bytearray(b"abc" * 20),)], "b binary").select(xxh64_column(F.col("b")).alias("h")).first()["h"]
    assert raw % 2**64 == xxhash.xxh64_intdigest(b"abc" * 20)


def test_clock_pack(spark):
    rows = [(0, 0), (1, 65535), (2**41, 7), (2**47 - 1, 1)]
    got = spark.createDataFrame(rows, "w long, c long").select(hlc.pack(F.col("w"), F.col("c")).alias("h")).select("h", hlc.wall(F.col("h")).alias("w"), hlc.counter(F.col("h")).alias("c")).collect()
    assert [(r["w"], r["c"]) for r in got] == rows and [r["h"] for r in got] == [w << 16 | c for w, c in rows]


def test_clock_grows():
    c = hlc.Clock(lambda: 5)
    stamps = [c.now() for _ in range(70_000)]
    assert all(a < b for a, b in zip(stamps, stamps[1:])) and stamps[0] == 5 << 16
    assert c.update(9 << 40) == (9 << 40) + 1
    full = (7 << 16) | 65535
    c.update(full)
    assert c.now() > full and hlc.Clock(lambda: 1).update(full) == full + 1
    assert c.now(10) + 10 == c.now()
