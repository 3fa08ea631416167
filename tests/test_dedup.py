"""Seen sets, Bloom tables, upsert and strikes."""

import random
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from contentlake.operators import dedup
from contentlake.operators.bloom import BloomShape, BloomTable
from test_plans import plan


def test_bloom_no_false_negatives_and_rate(spark):
    keys = spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    bloom = BloomTable.build(keys.unionAll(keys), "k", 20_000, 0.01)
    assert bloom.probe(keys, "k").filter("NOT maybe_seen").count() == 0
    others = spark.range(100_000, 140_000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    assert bloom.probe(others, "k").filter("maybe_seen").count() <= 40_000 * 0.02
    stats = bloom.stats().first()
    assert 0 < stats["bits_set"] < stats["bits"] and stats["hashes"] == 7


def test_bloom_add_reset_save_load(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    a = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    b = spark.createDataFrame([("c",)], "k string")
    bloom = BloomTable.empty(spark, 1000).add(a, "k").add(b, "k")
    bloom.save(f"{folder}/bloom")
    loaded = BloomTable.load(spark, f"{folder}/bloom", 1000, 0.001)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "k string")
    assert {r["k"]: r["maybe_seen"] for r in loaded.probe(asked, "k").collect()} == {"a": True, "b": True, "c": True, "d": False, None: False}
    assert BloomTable.load(spark, f"{folder}/bloom", 1000, 0.01) is None
    assert BloomTable.load(spark, f"{folder}/bloom", 2000, 0.001) is None
    with pytest.raises(ValueError):
        bloom.union(BloomTable.empty(spark, 2000))
    assert BloomShape(30_000_000, 0.001).hashes == 10


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, 0, "old"), ("b", 1, 0, "keep")], "info_hash string, added_ts int, seq int, name string")
    batch = spark.createDataFrame([("a", 2, 1, "x"), ("a", 2, 2, "y"), ("c", 1, 1, "new")], base.schema)
    once = dedup.upsert_items(base, batch)
    twice = dedup.upsert_items(once, batch)
    wanted = {("a", "y"), ("b", "keep"), ("c", "new")}
    for df in (once, twice):
        assert df.count() == 3 and {(r["info_hash"], r["name"]) for r in df.collect()} == wanted


def test_observed_batch(spark):
    batch = spark.createDataFrame([("a" * 40, "x"), ("a" * 39, "x"), (None, "x"), ("b" * 40, None)], "info_hash string, name string")
    counted, watch = dedup.observe_batch(batch)
    counted.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 4, "written": 1}
    assert tuple(dedup.batch_outcomes(batch).first()) == (4, 1, 3, 1)


def strikes_model(rows):
    state, out = {}, {}
    for key, _, _, outcome in sorted(rows, key=lambda r: (r[1], r[2])):
        first, second, seen = out.get(key, (False, False, None))
        if seen is None and outcome == "failed":
            state[key] = state.get(key, 0) + 1
            first, second = True, state[key] == 2
            seen = "blocked" if second else None
        elif seen is None and outcome in ("fetched", "filtered"):
            seen = outcome
        out[key] = (first, second, seen)
    return out


def random_attempts(n, keys, seed):
    rng = random.Random(seed)
    kinds = ["failed"] * 6 + ["fetched", "filtered", "observed"]
    # a third of all rows belong to one key; times collide
    return [(f"k{0 if rng.random() < 0.33 else rng.randrange(keys)}", rng.randrange(n // 3), i, rng.choice(kinds)) for i in range(n)]


def test_two_strike_model(spark):
    rows = random_attempts(3000, 400, 3)
    df = spark.createDataFrame(rows, "info_hash string, ts int, event_id int, outcome string").repartition(5)
    got = {r["info_hash"]: (r["first_strike"], r["second_strike"], r["seen_as"]) for r in dedup.two_strike(df).collect()}
    assert got == strikes_model(rows)


def test_priority_rows_bypass(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("z", None)], "info_hash string, p boolean")
    store = spark.createDataFrame([("a",)], "info_hash string")
    bloom = BloomTable.build(rows, "info_hash", 100)  # reports a, b and z
    kept = dedup.drop_confirmed(rows, bloom, store, priority=F.col("p"))
    assert sorted((r["info_hash"], r["p"]) for r in kept.collect() if r["p"] is not None) == [("a", True), ("b", False)]
    assert kept.count() == 3


def test_fifo_and_fill(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 9), ("c", 3)], "k string, ts int")
    assert [r["k"] for r in dedup.fifo_cache(rows, "k", "ts", 2).collect()] == ["c", "b"]
    base = spark.createDataFrame([("a", 0)], "k string, ts int")
    filled = dedup.fill_from(base, rows.select("k", F.lit(0).alias("ts")), 1, "k", [F.asc("k")])
    assert sorted(r["k"] for r in filled.collect()) == ["a", "b"]


def test_dictionary_keeps_ids_and_loses_no_prefix(spark):
    from contentlake.operators import normalise

    old = spark.createDataFrame([("b/x",), ("d/y",), ("root",)], "path string")
    encoded, first = normalise.encode_prefixes(old)
    more = spark.createDataFrame([("a/1",), ("d/2",), ("c/3",), ("/lead",), ("tail/",), ("",)], "path string")
    again, second = normalise.encode_prefixes(more, first)
    ids = {p: int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in ("b", "d", "a", "c", "tail")}
    assert {r["prefix"]: r["prefix_id"] for r in second.collect()} == ids and second.count() == 5
    assert "Exchange" not in plan(again)
    rebuilt = {r["path"] for r in normalise.rebuild_paths(again, second).collect()}
    assert rebuilt == {"a/1", "d/2", "c/3", "lead", "tail/", ""}
    assert {r["path"] for r in normalise.rebuild_paths(encoded, second).collect()} == {"b/x", "d/y", "root"}


def test_numbered_dictionary_is_joined_back_and_extended(spark):
    from contentlake.operators import normalise

    old = spark.createDataFrame([("d/y",), ("b/x",), ("root",), (None,)], "path string")
    encoded, first = normalise.encode_numbered(old)
    assert sorted(map(tuple, encoded.select("prefix_id", "filename").collect()), key=repr) == [(1, "x"), (2, "y"), (None, "root"), (None, None)]
    more = spark.createDataFrame([("a/1",), ("d/2",), ("c/3",), ("tail/",), ("",)], "path string")
    again, second = normalise.encode_numbered(more, first)
    assert {(r["prefix"], r["prefix_id"]) for r in second.collect()} == {("b", 1), ("d", 2), ("a", 3), ("c", 4), ("tail", 5)}
    assert sorted(r["path"] for r in normalise.rebuild_paths(again, second).collect()) == ["", "a/1", "c/3", "d/2", "tail/"]


def test_encoded_files_hold_the_numbers_of_the_dictionary(spark, folder):
    from contentlake import plans

    ids = [r["prefix_id"] for r in plans.QUERIES["d2_encode_prefixes"](spark, folder).select("prefix_id").distinct().collect()]
    assert sorted(i for i in ids if i) == list(range(1, plans.QUERIES["d2_prefix_dictionary"](spark, folder).count() + 1))
    assert "dict" in plans.ORACLE["d2_encode_prefixes"]


def test_prefixes_that_share_an_id_get_their_own(spark, monkeypatch):
    from contentlake.operators import normalise

    monkeypatch.setattr(normalise, "ID_DIGITS", 2)  # 256 ids for 90 prefixes
    names = [f"p{k}" for k in range(90)]
    old, new = (spark.createDataFrame([(f"{p}/f{k}",) for k, p in enumerate(part)], "path string") for part in (names[:50], names))
    _, first = normalise.encode_prefixes(old, shared=normalise.shared_ids(old))
    shared = normalise.shared_ids(new, first)
    assert 0 < shared.count() < 90
    encoded, both = normalise.encode_prefixes(new, first, shared)
    kept = {r["prefix"]: r["prefix_id"] for r in both.collect()}
    assert both.count() == len(kept) == len(set(kept.values())) == 90
    assert all(kept[r["prefix"]] == r["prefix_id"] for r in first.collect())
    assert sorted(r["path"] for r in normalise.rebuild_paths(encoded, both).collect()) == sorted(r["path"] for r in new.collect())


def test_bloom_of_a_small_capacity_takes_many_keys(spark):
    bloom = BloomTable.build(spark.range(10_000_000), "id", 1000)
    assert bloom.words.count() <= 512 and bloom.stats().first()["bits_set"] == 32768
    few = BloomTable.build(spark.range(50).union(spark.range(50)), "id", 1000)
    asked = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"))
    seen = few.probe(asked, "id").groupBy("id").agg(F.max("maybe_seen").alias("m"), F.count("*").alias("n")).collect()
    flags = {r["id"]: r["m"] for r in seen}
    assert sum(r["n"] for r in seen) == 2000 and flags[None] is False
    assert all(flags[k] for k in range(0, 50, 2)) and sum(flags[k] for k in range(50, 2000, 2)) <= 4


def test_many_rows_without_a_key_are_dealt_out(spark):
    from contentlake.operators.frames import join_nullable

    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), "id")
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = join_nullable(left, right, "k")
    assert out.count() == 5000 and out.filter("v IS NOT NULL").count() == len([i for i in range(0, 5000, 6)])


def test_first_rows_and_winning_versions(spark):
    batch = spark.createDataFrame([("a", k) for k in range(999, -1, -1)] + [("b", 5)], "k string, n int").repartition(7)
    base = spark.createDataFrame([("b", 0)], "k string, n int")
    assert sorted(map(tuple, dedup.insert_new(base, batch, "k", [F.asc("n")]).collect())) == [("a", 0), ("b", 0)]
    assert sorted(map(tuple, dedup.fill_from(base, batch, 5, "k", [F.asc("n")]).collect())) == [("a", 0), ("b", 0)]
    old = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "item_id int, path string")
    new = spark.createDataFrame([(1, "v1", 1), (1, "v2", 2), (2, "v1", 1)], "item_id int, path string, seq int")
    winners = spark.createDataFrame([(1, 2), (2, 2)], "item_id int, seq int")
    assert sorted(map(tuple, dedup.upsert_files(old, new, winners=winners).collect())) == [(1, "v2"), (3, "old")]
