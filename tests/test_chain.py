"""The stored catalogue, the seen store and the ingest chain over many batches, with repeats, merges and a lost driver."""

import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators.bloom import BloomTable  # noqa: F401
from contentlake.sources.buckets import Buckets
from contentlake.sources.catalogstore import CatalogStore
from contentlake.streaming import chain
from contentlake.streaming import processors as sp
from contentlake.streaming import streams as st
from test_dedup import random_attempts, strikes_model
from test_streams import as_stream, folder

ITEM = "info_hash string, name string, size_bytes bigint, total_peers int, added_ts timestamp, seq bigint"
FILE = "info_hash string, seq bigint, file_index int, path string, size_bytes bigint"


def batches(seed, count=9):
    """Batches of items and files, with versions inside a batch, late ones, and items without files."""
    rng = random.Random(seed)
    for _ in range(count):
        items, files = [], []
        for seq in range(rng.randrange(1, 25)):
            key = f"k{rng.randrange(30)}"
            items.append((key, f"n{rng.random():.6f}", 1, 2, rng.randrange(6) * 3600, seq))
            files += [(key, seq, i, rng.choice(["a/b/x", "a/y", "z", "/w"]) + str(i), 7) for i in range(rng.randrange(4))]
        yield items, files


def model(done):
    best = {}
    for epoch, (items, files) in enumerate(done):
        for key, name, _, _, added, seq in items:
            if key not in best or (added, epoch, seq) > best[key][0]:
                own = sorted((f[2], f[3].lstrip("/")) for f in files if (f[0], f[1]) == (key, seq))
                best[key] = ((added, epoch, seq), name, own)
    return {key: (name, own) for key, (_, name, own) in best.items()}


def state(catalog):
    files = {}
    for r in catalog.files().collect():
        files.setdefault(r["info_hash"], []).append((r["file_index"], r["path"]))
    return {r["info_hash"]: (r["name"], sorted(files.get(r["info_hash"], []))) for r in catalog.items().collect()}


def frames(spark, items, files):
    rows = spark.createDataFrame(items, "info_hash string, name string, size_bytes bigint, total_peers int, added long, seq bigint")
    rows = rows.withColumn("added_ts", F.timestamp_seconds("added")).drop("added")
    return rows, spark.createDataFrame(files, FILE)


def test_catalog_store_equals_model(spark, tmp_path):
    catalog, done = CatalogStore.create(spark, str(tmp_path / "c"), 4), []
    assert state(catalog) == {}
    for epoch, (items, files) in enumerate(batches(3)):
        done.append((items, files))
        for _ in range(1 + epoch % 2):  # every other batch comes twice
            assert catalog.write(*frames(spark, items, files), epoch)
        if epoch % 3 == 1:
            assert catalog.flush(rows=1)
            assert not catalog.write(*frames(spark, items, files), epoch)  # merged: the repeat is left out
        if epoch % 2:
            assert state(CatalogStore.open(spark, str(tmp_path / "c"))) == model(done)
    assert state(catalog) == model(done)


def test_flush_by_rows_or_time(spark, tmp_path):
    catalog = CatalogStore.create(spark, str(tmp_path / "c"), 2)
    (items, files), *_ = batches(5)
    catalog.write(*frames(spark, items, files), 0)
    assert catalog.flush(rows=1)
    catalog.write(*frames(spark, items, files), 1)
    assert not catalog.flush(rows=len(items) + 1, seconds=3600)
    assert not catalog.flush(rows=1, before=1)
    assert catalog.flush(rows=len(items), seconds=3600)
    catalog.write(*frames(spark, items, files), 2)
    assert catalog.flush(rows=10**9, seconds=0) and not catalog.flush(rows=0, seconds=0)


def test_old_versions_go_and_one_is_kept(spark, tmp_path):
    store = Buckets.create(spark, str(tmp_path / "s"), {"seen": (spark.createDataFrame([], "k string").schema, "k")}, 2)
    held = []
    for epoch in range(6):
        store.append({"seen": spark.createDataFrame([(f"k{epoch}",)], "k string")}, epoch)
        store.merge(st.merge_keys)
        held.append(sorted(r["k"] for r in store.base("seen").collect()))
    assert held[-1] == [f"k{e}" for e in range(6)]
    home = tmp_path / "s"
    assert len(list((home / "manifest").glob("number=*"))) == 2
    assert len(list((home / "delta" / "seen").glob("epoch=*"))) <= 2
    assert len(list((home / "base" / "seen").glob("version=*/bucket=*"))) <= 4


def test_a_lost_merge_changes_nothing(spark, tmp_path):
    store = Buckets.create(spark, str(tmp_path / "s"), {"seen": (spark.createDataFrame([], "k string").schema, "k")}, 2)
    store.append({"seen": spark.createDataFrame([("a",)], "k string")}, 0)

    def broken(base, delta):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.merge(broken)
    assert store.waiting() == [0] and store.base("seen").count() == 0
    store.merge(st.merge_keys)
    assert store.waiting() == [] and store.base("seen").count() == 1


def test_admitted_keys_open_few_epochs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(60)}" if rng.random() < 0.95 else None, i) for i in range(400)]
    seen = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,)], "key string")
    opened = []
    delta = Buckets.delta
    monkeypatch.setattr(Buckets, "delta", lambda self, name, epochs: opened.append(len(epochs)) or delta(self, name, epochs))
    path = folder()
    stream = as_stream(spark, rows, "key string, id long", parts=10)
    st.admit_new(stream, seen, "key", [F.asc("id")], path, f"{path}/checkpoint", True, 4, 3).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{path}/rows").select("key", "id").collect()))
    first = {}
    for key, i in rows:
        if key not in (None, "k1", "k2"):
            first.setdefault(key, i)
    assert got == sorted(first.items())
    assert 3 <= max(opened) <= 4  # ten batches, but never more than those since the last merge


def test_rolling_hours(spark):
    rng = random.Random(6)
    base = 1_700_000_000
    rows = sorted((base + int(rng.random() ** 2 * 9 * 3600), rng.choice("ab")) for _ in range(700))
    stream = as_stream(spark, [(k, t) for t, k in rows], "key string, at long", parts=5).select("key", F.timestamp_seconds("at").alias("ts"))
    out = st.run_to_end(sp.hour_stream(stream, "10 minutes", keep=60), folder(), "update")
    got = {(r["key"], r["minute"]): r["last_hour"] for r in out.groupBy("key", "minute").agg(F.max_by("last_hour", "epoch").alias("last_hour")).collect()}
    want = {}
    for t, k in rows:
        for later in range(60):
            want[k, t // 60 + later] = want.get((k, t // 60 + later), 0) + 1
    assert got == want


RECORD = "info_hash string, at timestamp, event_id bigint, outcome string, name string, size_bytes bigint, total_peers int, files array<struct<file_index:int,path:string,size_bytes:bigint>>"


def record_rows(count=500, keys=80):
    out = []
    for key, at, i, kind in random_attempts(count, keys, 3):
        name = "banned thing" if i % 3 == 0 else f"thing {i}"
        out.append((key, at, i, {"filtered": "fetched"}.get(kind, kind), name, 5, 1, [(0, f"p/{i}", 5)] * (i % 2)))
    return sorted(out, key=lambda r: (r[1], r[2]))


def chain_model(rows):
    judged = [(k, at, i, "filtered" if o == "fetched" and "banned" in name else o) for k, at, i, o, name, *_ in rows]
    wanted = strikes_model(judged)
    names = {}
    for k, _, i, o, name, _, _, files in rows:
        if o == "fetched" and k not in names:
            names[k] = (name, [f[1] for f in files])
    return {k: (seen, names[k] if seen == "fetched" else None) for k, (_, _, seen) in wanted.items() if seen}, {
        k for k, (first, _, seen) in wanted.items() if first and not seen
    }


def chain_state(store):
    now = chain.tables(store)
    paths = {}
    for r in chain.catalogstore.rebuild_paths(now["files"], now["prefixes"]).collect():
        paths.setdefault(r["info_hash"], []).append(r["path"])
    items = {r["info_hash"]: (r["name"], sorted(paths.get(r["info_hash"], []))) for r in now["items"].collect()}
    seen = {r["info_hash"]: r["seen_as"] for r in now["seen"].collect()}
    assert set(items) == {k for k, s in seen.items() if s == "fetched"}
    return {k: (s, items.get(k)) for k, s in seen.items()}, {r["info_hash"] for r in now["strikes"].collect()}


def test_chain_is_killed_and_restarted(spark, monkeypatch):
    rows = record_rows()
    typed = [(k, None, i, o, n, s, p, f, at) for k, at, i, o, n, s, p, f in rows]
    stream = as_stream(spark, typed, RECORD + ", micros bigint", parts=8).withColumn("at", F.timestamp_micros("micros")).drop("micros")
    path = folder()
    store = chain.create_store(spark, f"{path}/store", 4)

    def rejected(batch):
        return F.contains("name", F.lit("banned"))

    take, calls = chain.take_batch, []

    def dies(own, batch, epoch, judge):
        take(own, batch, epoch, judge)
        calls.append(epoch)
        if len(calls) in (3, 6):
            raise RuntimeError("the driver is lost after the epoch was written, before the stream notes it")

    monkeypatch.setattr(chain, "take_batch", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            chain.ingest_stream(stream, store, f"{path}/checkpoint", rejected, True, merge_after=2).awaitTermination()
    chain.ingest_stream(stream, Buckets.open(spark, f"{path}/store"), f"{path}/checkpoint", rejected, True, merge_after=2).awaitTermination()
    assert len(calls) == 10 and len(set(calls)) == 8  # two batches came twice
    assert store.manifest().number >= 2
    assert chain_state(store) == chain_model(rows)
