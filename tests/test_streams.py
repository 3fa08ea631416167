"""Streams over several files and micro-batches against the batch operators and small models."""

import os
import random
import tempfile
from glob import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contentlake.operators import dedup
from contentlake.sources.sinks import read_catalog
from contentlake.streaming import processors as sp
from contentlake.streaming import streams as st

from test_dedup import random_attempts, strikes_model
from test_nodes_and_peers import refresh_model, refresh_rows


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def as_stream(spark, rows, schema, parts=4, max_files=1):
    """Rows in ``parts`` files in the given order, read one file per micro-batch."""
    path, size = folder(), -(-len(rows) // parts)
    for i in range(parts):
        known = set(glob(f"{path}/*.parquet"))
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        for new in set(glob(f"{path}/*.parquet")) - known:
            os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of time
    return st.read_events(spark, path, spark.read.parquet(path).schema, max_files)


def test_strikes(spark):
    # the watermark starts at 1970, where rows count as late
    rows = [(key, at + 86_400_000_000, i, kind) for key, at, i, kind in random_attempts(900, 120, 8)]
    stream = as_stream(spark, rows, "info_hash string, at bigint, event_id bigint, outcome string")
    out = st.last_update(st.run_to_end(sp.strike_stream(stream), folder(), "update"), "info_hash")
    got = {r["info_hash"]: (r["first_strike"], r["second_strike"], r["seen_as"]) for r in out.collect()}
    wanted = {key: v for key, v in strikes_model(rows).items() if v != (False, False, None)}
    assert got == wanted
    batch = spark.createDataFrame(rows, "info_hash string, ts bigint, event_id bigint, outcome string")
    assert {r["info_hash"]: (r["first_strike"], r["second_strike"], r["seen_as"]) for r in dedup.two_strike(batch).collect()} == strikes_model(rows)


def test_strikes_are_forgotten(spark):
    second = 1_000_000
    rows = [("a", 1 * second, 1, "failed"), ("b", 9000 * second, 2, "failed"), ("b", 9001 * second, 3, "failed"), ("a", 9100 * second, 4, "failed")]
    stream = as_stream(spark, rows, "info_hash string, at bigint, event_id bigint, outcome string")
    out = st.last_update(st.run_to_end(sp.strike_stream(stream, forget=600, delay="1 minute"), folder(), "update"), "info_hash")
    assert {r["info_hash"]: r["second_strike"] for r in out.collect()} == {"a": False, "b": True}


def test_peer_lists(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(30), 80, rng.randrange(1000)) for _ in range(800)]
    out = st.run_to_end(sp.peer_list_stream(as_stream(spark, rows, "key bigint, ip bigint, port bigint, at bigint"), 30), folder(), "update")
    newest = out.groupBy("key").agg(F.max("epoch").alias("epoch"))
    got = {(r["key"], r["ip"]): r["at"] for r in out.join(newest, ["key", "epoch"]).collect()}
    wanted = {}
    for key, ip, _, at in rows:
        wanted[key, ip] = max(at, wanted.get((key, ip), at))
    assert got == wanted


def test_retries(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), 10 * i + rng.randrange(10), i, rng.choice([0, 3, 12])) for i in range(400)]
    out = st.run_to_end(sp.retry_stream(as_stream(spark, rows, "key bigint, at bigint, event_id bigint, peers bigint"), 3, 10, 2500, 120), folder(), "update")
    got = {(r["key"], r["at"]): (r["attempts"], r["decision"], r["due_at"]) for r in out.collect()}
    state, wanted = {}, {}
    for key, at, _, peers in rows:
        retries, created = state.get(key, (0, at))
        if at - created > 120:
            retries, created = 0, at
        if peers >= 10 or retries >= 3:
            wanted[key, at] = (retries + 1, "complete" if peers else "failed", None)
            state.pop(key, None)
        else:
            wanted[key, at] = (retries + 1, "retry", at + 2)
            state[key] = (retries + 1, created)
    assert got == wanted


def test_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), f"n{rng.randrange(14)}", 5 * i, i, rng.choice(["seen", "seen", "failed"])) for i in range(500)]
    stream = as_stream(spark, rows, "bucket int, node_id string, at bigint, event_id bigint, kind string")
    out = st.run_to_end(sp.bucket_stream(stream, cap=5, max_failures=3, min_age=60), folder(), "update")
    newest = out.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    got = {(r["bucket"], r["node_id"]): (r["last_seen"], r["fail_count"]) for r in out.join(newest, ["bucket", "epoch"]).collect()}
    held = {0: {}, 1: {}}
    for bucket, node, at, _, kind in rows:
        nodes = held[bucket]
        if kind == "failed":
            if node in nodes:
                nodes[node] = (nodes[node][0], nodes[node][1] + 1)
                if nodes[node][1] >= 3:
                    del nodes[node]
        elif node in nodes:
            nodes[node] = (at, 0)
        else:
            if len(nodes) >= 5:
                oldest = min(nodes, key=lambda n: (nodes[n][0], n))
                if at - nodes[oldest][0] < 60:
                    continue
                del nodes[oldest]
            nodes[node] = (at, 0)
    assert got == {(b, n): v for b, nodes in held.items() for n, v in nodes.items()}


def test_refresh(spark):
    requests, answers = refresh_rows(12, 120)
    rows = [(h, t, None, None, None, n) for h, t, n in answers] + [(h, t, i, d, d2, 0) for i, h, t, d, d2 in requests]
    rows.sort(key=lambda r: r[1])
    rows.append(("end", 10_000, None, None, None, 1))  # moves the watermark past every wait
    schema = "info_hash string, at bigint, request_id bigint, done_at bigint, retry_done_at bigint, peers bigint"
    stream = as_stream(spark, rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    out = st.run_to_end(sp.refresh_stream(stream, "20 seconds", 8), folder(), "update").collect()
    got = {r["request_id"]: (r["total_peers"], r["timed_out"], r["retry_attempted"]) for r in out if r["closed"]}
    assert got == refresh_model(requests, answers, 8)
    assert sum(r["closed"] for r in out) == len(requests)


def test_calls_to_the_refresh_state_follow_keys(spark):
    """However many requests and answers a key has, it has one timer; ends at the very watermark are closed."""

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows) if self.many else self.rows[0]

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def appendList(self, rows):
            self.rows, self.calls = self.rows + list(rows), self.calls + 1

        def exists(self):
            return bool(self.rows)

        def update(self, row):
            self.put([row])

        def clear(self):
            self.put([])

    class Handle:
        def __init__(self):
            self.timers, self.states, self.moves = set(), {}, 0

        def state(self, name, many):
            self.states[name] = State()
            self.states[name].many = many
            return self.states[name]

        def getListState(self, name, schema):
            return self.state(name, True)

        def getValueState(self, name, schema):
            return self.state(name, False)

        def registerTimer(self, at):
            self.timers.add(at)
            self.moves += 1

        def deleteTimer(self, at):
            self.timers.remove(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    processor, handle, none = sp.RefreshProcessor(8), Handle(), float("nan")
    processor.init(handle)
    rows = [(i, i, none, none, 0) for i in range(0, 300, 3)] + [(i, none, none, none, 1) for i in range(300)]
    chunk = pd.DataFrame(rows, columns=["at", "request_id", "done_at", "retry_done_at", "peers"])
    first = pd.concat(processor.handleInputRows(("k",), iter([chunk]), At(0)))
    assert len(first) == 100 and handle.timers == {17_000} and handle.moves == 1
    handle.timers.clear()
    closed = pd.concat(processor.handleExpiredTimer(("k",), At(173_000), At(17_000)))
    assert sorted(closed["request_id"]) == list(range(0, 157, 3)) and closed["closed"].all()  # 156 + 8 + 8 + 1 is the watermark
    assert set(closed["total_peers"]) == {9}
    assert handle.timers == {176_000} and sum(s.calls for s in handle.states.values()) < 20
    assert min(at for at, _ in handle.states["answers"].rows) == 173


def state_rows(progress):
    return sum(p["numRowsTotal"] for p in progress["stateOperators"])


def test_state_ends(spark):
    """Keys that went quiet leave the state once the watermark has passed their time to be forgotten."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    rows = [(k, 10 * i, i) for i in range(10) for k in range(20)] + [(99, 100_000, 1), (99, 100_010, 2)]
    rows += [(99, 100_020 + i, i) for i in range(18)]
    counters = as_stream(spark, rows, "key bigint, at bigint, n bigint", parts=11)
    peers = as_stream(spark, [(k, 7, 80, at) for k, at, _ in rows], "key bigint, ip bigint, port bigint, at bigint", parts=11)
    for stream in (sp.ema_stream(counters, 1.0, 100, 0, forget=600, delay="1 minute"), sp.peer_list_stream(peers, 5, 600, "1 minute")):
        path = folder()
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/k").trigger(availableNow=True)
        query = query.foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save()).start()
        query.awaitTermination()
        held = [state_rows(p) for p in query.recentProgress if p["stateOperators"]]
        assert max(held) >= 20 and held[-1] < max(held) / 4, held


def test_admit_new_follows_the_stream(spark):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(60)}" if rng.random() < 0.95 else None, i) for i in range(300)]
    stream = as_stream(spark, rows, "key string, seq bigint", parts=6)
    seen = spark.createDataFrame([("k1",), ("k2",), (None,)], "key string")
    path = folder()
    for _ in range(2):  # a second run finds nothing new
        st.admit_new(stream, seen, "key", [F.col("seq")], path, f"{path}/k", available_now=True).awaitTermination()
    wanted = {}
    for key, seq in rows:
        if key not in (None, "k1", "k2"):
            wanted.setdefault(key, seq)
    got = [(r["key"], r["seq"]) for r in spark.read.parquet(f"{path}/rows").collect()]
    assert sorted(got) == sorted(wanted.items())


def test_dedup_within_watermark(spark):
    rows = [("a", 1), ("a", 10), ("b", 20), ("c", 7200), ("c", 7300), ("a", 9000)]
    stream = as_stream(spark, rows, "k string, at bigint", parts=6).withColumn("ts", F.timestamp_seconds("at"))
    out = st.run_to_end(st.dedup_stream(stream, "k", "ts", "10 minutes"), folder())
    assert sorted((r["k"], r["at"]) for r in out.collect()) == [("a", 1), ("a", 9000), ("b", 20), ("c", 7200)]


def test_catalog_sink_and_compaction(spark):
    rows = [(f"k{i % 7}", i, f"v{i}") for i in range(40)]
    stream = as_stream(spark, rows, "info_hash string, added_ts bigint, name string")
    path = folder()
    st.catalog_sink(stream, f"{path}/c", f"{path}/k", available_now=True).awaitTermination()
    wanted = {f"k{i % 7}": f"v{i}" for i in range(40)}
    assert {r["info_hash"]: r["name"] for r in read_catalog(spark, f"{path}/c").collect()} == wanted
    st.compact_catalog(spark, f"{path}/c", f"{path}/d")
    assert {r["info_hash"]: r["name"] for r in read_catalog(spark, f"{path}/d").collect()} == wanted


@pytest.mark.parametrize("grace", [0, 30])
def test_ema_alerts_match_batch(spark, grace):
    from contentlake.operators import monitor as m

    rng = random.Random(7)
    rows = [(key, 1000 + 10 * i, sum(rng.choice([0, 0, 1, 5]) for _ in range(2)) + 10 * i) for i in range(60) for key in range(3)]
    counters = spark.createDataFrame(rows, "key bigint, at bigint, n bigint")
    readings = m.interval_rate(counters, "key")
    batch = m.low_rate(readings, "key", 1.0, 100, grace).collect()
    stream = as_stream(spark, rows, "key bigint, at bigint, n bigint", parts=5)
    out = st.run_to_end(sp.ema_stream(stream, 1.0, 100, grace), folder(), "update").collect()
    assert {(r["key"], r["at"]): (round(r["ema"], 9), r["low"]) for r in out if r["shut_down_at"] is None} == {
        (r["key"], r["at"]): (round(r["ema"], 9), r["low"]) for r in batch
    }
    alerts = {(r["key"], r["at"]) for r in out if r["shut_down_at"] is not None}
    assert alerts == {(r["key"], r["at"]) for r in batch if r["shut_down"]} and alerts
