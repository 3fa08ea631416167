"""Records, compact lists, keyword files, snapshots, batch sink."""

import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from contentlake.sources import compact, lists, records, sinks, snapshot


def bencode(value) -> bytes:
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return b"%d:%s" % (len(value), value)
    if isinstance(value, list):
        return b"l" + b"".join(map(bencode, value)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(v) for k, v in sorted(value.items())) + b"e"


CASES = [
    ({"name": "a", "length": 5}, ("a", 5, [("a", 5)])),
    ({"name": "a", "length": 0}, ("a", 0, [("a", 0)])),
    ({"name": "ü", "files": [{"length": 2, "path": ["x", "y é"]}, {"length": 3, "path": ["z"]}]}, ("ü", 5, [("x/y é", 2), ("z", 3)])),
    ({"name": "a", "length": 7, "files": [{"length": 2, "path": ["x"]}]}, ("a", 7, [("a", 7)])),
    ({"name": "a", "files": [{"length": 2, "path": []}, {"path": ["p"]}]}, ("a", 0, [("p", 0)])),
    ({"name": "a", "piece length": 16384}, ("a", 0, [("a", 0)])),
    ({"length": 5}, None),
]


def test_decode(spark):
    blobs = [(i, bytearray(bencode(v))) for i, (v, _) in enumerate(CASES)] + [(90, bytearray(b"")), (91, bytearray(b"d4:name9:abce")), (92, None)]
    df = spark.createDataFrame(blobs, "i int, blob binary")
    got = {r["i"]: (r["name"], r["size_bytes"], [tuple(f) for f in r["files"]]) for r in records.decode_records(df, "blob").collect()}
    assert got == {i: wanted for i, (_, wanted) in enumerate(CASES) if wanted}
    strict = records.decode_records(df, "blob", strict=True).select("i").collect()
    assert 5 not in {r["i"] for r in strict}


def test_digest_and_size(spark):
    blob = bencode({"name": "a"})
    good = hashlib.sha1(blob).hexdigest().upper()
    df = spark.createDataFrame([(bytearray(blob), good), (bytearray(blob + b"x"), good), (None, good)], "blob binary, k string")
    assert records.verify_digest(df, "blob", "k").count() == 1
    assert tuple(records.digest_counts(df, "blob", "k").first()) == (1, 2)
    assert records.limit_size(df, "blob", len(blob)).count() == 1


def test_read_files_and_item_rows(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i in range(3):
        with open(f"{folder}/{i}.bin", "wb") as f:
            f.write(bencode({"name": f"n{i}", "files": [{"length": i, "path": ["d", "x"]}, {"length": 1, "path": ["y"]}]}))
    decoded = records.decode_records(records.read_records(spark, folder).withColumn("info_hash", F.sha1("blob")), "blob")
    items, files = records.to_item_rows(decoded, F.lit(4), F.lit(1))
    assert [tuple(r) for r in items.orderBy("name").select("name", "size_bytes", "total_peers", "added_ts").collect()] == [(f"n{i}", i + 1, 4, 1) for i in range(3)]
    assert files.filter("path = 'd/x'").agg(F.sum("size_bytes"), F.max("file_index")).first() == (3, 0)


def test_ids_are_capped_at_100(spark):
    blob = b"".join(hashlib.sha1(b"%d" % i).digest() for i in range(130)) + b"rest"
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(b"short")), (3, None)], "k int, ids binary")
    rows = compact.explode_ids(df, "ids").orderBy("position").collect()
    assert [r["id"] for r in rows] == [hashlib.sha1(b"%d" % i).hexdigest() for i in range(100)]


def test_peer_cap_counts_valid_ones(spark):
    def peer(ip, port):
        return ip.to_bytes(4, "big") + port.to_bytes(2, "big")

    blob = peer(0, 1) + peer(1, 0) + peer(0xFFFFFFFF, 9) + b"".join(peer(i, 80) for i in range(1, 9)) + b"xy"
    df = spark.createDataFrame([(1, bytearray(blob))], "k int, peers binary")
    rows = compact.explode_peers(df, "peers", 5).orderBy("position").collect()
    assert [(r["position"], r["ip"], r["port"]) for r in rows] == [(i, i + 1, 80) for i in range(5)]


def test_nodes(spark):
    ids = [hashlib.sha1(b"%d" % i).digest() for i in range(300)]
    blob = b"".join(h + (i % 50).to_bytes(4, "big") + b"\x1a\xe1" for i, h in enumerate(ids))
    df = spark.createDataFrame([(1, bytearray(blob))], "k int, nodes binary")
    rows = compact.explode_nodes(df, "nodes").orderBy("position").collect()
    valid = [(h.hex(), i % 50, 0x1AE1) for i, h in enumerate(ids) if i % 50]
    assert [(r["node_id"], r["ip"], r["port"]) for r in rows] == valid[:256]


def test_keyword_files(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{folder}/k.txt", "w") as f:
        f.write("# note\n\n Ring : 7 \nring:3\nGEAR\nbolt:99\nnut:-2\nnail:x\n:5\nwide:4:9\n")
    got = {r["keyword"]: r["weight"] for r in lists.load_keywords(spark, f"{folder}/k.txt").collect()}
    assert got == {"ring": 7, "gear": 5, "bolt": 10, "nut": 1, "nail": 1, "wide": 4}
    with open(f"{folder}/s.txt", "w") as f:
        f.write("B\n# x\n a \r\nb\n\nA.1\n")
    assert lists.strip_words(lists.load_strip_list(spark, f"{folder}/s.txt")) == ["b", "a", "a.1"]


def test_snapshot(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([(i, None if i % 3 else f"n{i}") for i in range(50)], "i int, s string")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load_snapshot(spark, f"{folder}/none")
    assert snapshot.save_snapshot(df.limit(0), f"{folder}/a") is False
    assert snapshot.save_snapshot(df, f"{folder}/a")
    assert snapshot.save_snapshot(df.filter("i < 20").repartition(5), f"{folder}/a")
    loaded = snapshot.load_snapshot(spark, f"{folder}/a")
    assert sorted(tuple(r) for r in loaded.collect()) == sorted(tuple(r) for r in df.filter("i < 20").collect())
    data = loaded.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    df.filter("i < 20").withColumn("s", F.lit("changed")).write.mode("overwrite").parquet(data)
    with pytest.raises(snapshot.SnapshotError, match="digest"):
        snapshot.load_snapshot(spark, f"{folder}/a")
    df.filter("i < 19").write.mode("overwrite").parquet(data)
    with pytest.raises(snapshot.SnapshotError, match="rows"):
        snapshot.load_snapshot(spark, f"{folder}/a")


def test_digest_ignores_order_only(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    assert snapshot.digest(df) == snapshot.digest(df.repartition(9).orderBy(F.desc("id")).select("x", "id"))
    assert snapshot.digest(df) != snapshot.digest(df.withColumn("x", F.col("id") % 6))


def test_batches_are_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "info_hash string, added_ts int, name string")
    newer = spark.createDataFrame([("a", 1, "z"), ("c", 0, "c")], "info_hash string, added_ts int, name string")
    for _ in range(2):
        sinks.write_catalog_batch(rows, f"{folder}/c", 0)
        sinks.write_catalog_batch(newer, f"{folder}/c", 1)
        got = {(r["info_hash"], r["name"]) for r in sinks.read_catalog(spark, f"{folder}/c").collect()}
        assert got == {("a", "z"), ("b", "y"), ("c", "c")}


def test_records_that_cannot_be_read_end_no_job(spark):
    long_number = b"d6:lengthi99999999999999999999e4:name1:xe"
    parts = b"d5:filesld6:lengthi1e4:pathl0:1:aeee4:name1:xe"
    two = b"d5:filesl" + b"d6:lengthi9223372036854775807e4:pathl1:aee" * 2 + b"e4:name1:xe"
    cases = [long_number, parts, two, b"d4:name1_0:0123456789e", b"d6:lengthi1_0e4:name1:xe", b"d4:name1:x4:name1:ye", b"d4:name1:xejunk", b"d4:name-3:xe"]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, cases))), "k int, blob binary")
    found = {r["k"]: r for r in records.decode_records(rows, "blob").collect()}
    assert set(found) == {1, 5, 6}
    assert [f["path"] for f in found[1]["files"]] == ["a"] and found[5]["name"] == "y" and found[6]["name"] == "x"
