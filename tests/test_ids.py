"""160-bit arithmetic against Python integers."""

import hashlib
import random

from pyspark.sql import functions as F

from contentlake.functions import ids


def digests(n):
    return [hashlib.sha1(str(i).encode()).hexdigest() for i in range(n)]


def test_distance_and_bucket(spark):
    rng = random.Random(1)
    pairs = []
    for h in digests(200):
        flip = rng.randrange(161)
        other = int(h, 16) ^ (rng.getrandbits(flip) if flip else 0)
        pairs.append((h, f"{other:040x}"))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", ids.xor_distance(a, b).alias("d"), ids.bucket_index(a, b).alias("k"),
                     ids.distance_share(a, b).alias("s"), ids.first_byte_distance(a, b).alias("f")).collect()
    for r in rows:
        x = int(r["a"], 16) ^ int(r["b"], 16)
        assert r["d"] == f"{x:040x}"
        assert r["k"] == (x.bit_length() - 1 if x else 0)
        assert abs(r["s"] - (x >> 96) / (2**64 - 1)) < 1e-12
        assert r["f"] == x >> 152


def test_partitions(spark):
    df = spark.createDataFrame([(h,) for h in digests(300)], "h string")
    for n in (1, 2, 3, 5, 7, 10, 24, 64, 256, 300, 1024):
        got = {r["h"]: r["p"] for r in df.select("h", ids.partition_of(F.col("h"), n).alias("p")).collect()}
        for h, p in got.items():
            first = int(h[:2], 16)
            if n & (n - 1) == 0:
                wanted = int(h[:8], 16) >> (32 - (n.bit_length() - 1))
            else:
                wanted = min(first * n // 256, n - 1)
            assert p == wanted, n


def test_centers_lie_in_their_partition(spark):
    for n in (1, 2, 3, 5, 7, 10, 16, 24, 32, 256, 1024):
        rows = spark.range(n).select(ids.partition_center(F.col("id"), n).alias("c"), "id")
        rows = rows.withColumn("inside", ids.in_partition(F.col("c"), F.col("id").cast("int"), n)).collect()
        assert all(r["inside"] and len(r["c"]) == 40 for r in rows), n
    assert spark.range(16).select(ids.partition_center(F.col("id"), 16)).collect()[5][0] == "5800" + "80" * 18


def test_id_check(spark):
    df = spark.createDataFrame([("a" * 40,), ("A" * 40,), ("a" * 39,), ("g" * 40,), ("a" * 40 + "\n",)], "h string")
    assert [r[0] for r in df.select(ids.is_id(F.col("h"))).collect()] == [True, True, False, False, False]
