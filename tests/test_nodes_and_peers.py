"""Node, peer and partition rules against small models."""

import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators import keyspace as k
from contentlake.operators import monitor as m
from contentlake.operators import peers as p


def test_eviction_score(spark):
    nodes = spark.createDataFrame(
        [("f" * 40, 10, 0, None), ("0" * 40, 10, 10, 1000), ("8" + "0" * 39, 0, 0, 850), ("0" * 39 + "1", 4, 1, 100)],
        "node_id string, queries_sent int, responses_received int, last_responded_at bigint",
    )
    got = {r["node_id"][0] + r["node_id"][-1]: round(r["score"], 6) for r in k.eviction_candidates(nodes, "0" * 40, 1000, 9).collect()}
    assert got == {"ff": 1.0, "00": 0.0, "80": 0.5, "01": 0.35}


def test_k_samples(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    one = [r["k"] for r in k.sample_k(df, "k", 50, seed=1).collect()]
    again = [r["k"] for r in k.sample_k(df.repartition(13), "k", 50, seed=1).collect()]
    other = [r["k"] for r in k.sample_k(df, "k", 50, seed=2).collect()]
    assert len(set(one)) == 50 and one == again and set(one) != set(other)
    assert k.sample_k(df, "k", 5000).count() == 1000
    hits = {}
    for seed in range(60):
        for r in k.sample_k(spark.range(20).select(F.col("id").alias("k")), "k", 5, seed).collect():
            hits[r["k"]] = hits.get(r["k"], 0) + 1
    # 300 draws over 20 keys: 15 expected each
    assert len(hits) == 20 and max(hits.values()) < 30


def test_percent_sample_is_repeatable(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    assert abs(k.sample_percent(df, "k", 17).count() - 3400) < 250
    assert k.sample_percent(df, "k", 0).count() == 0 and k.sample_percent(df, "k", 100).count() == 20_000


def test_cooldown_stamp(spark):
    nodes = spark.createDataFrame([("a", "capable", 95), ("b", "capable", 98), ("c", "incapable", 0), ("d", "capable", None)], "node_id string, status string, last_queried bigint")
    assert {r["node_id"] for r in k.capable_pool(nodes, 100, 3).collect()} == {"a", "d"}
    assert {r["node_id"] for r in k.capable_pool(nodes, 100, 0).collect()} == {"a", "b", "d"}
    sample, stamped = k.sample_capable(nodes, 9, 100, 3)
    assert sample.count() == 2
    assert {r["node_id"]: r["last_queried"] for r in stamped.collect()} == {"a": 100, "b": 98, "c": 0, "d": 100}


def test_prune_share(spark):
    nodes = spark.createDataFrame([(f"{i:02x}" + "0" * 38, i if i % 3 else None) for i in range(256)], "node_id string, last_responded_at bigint")
    distant = [i for i in range(256) if i > 128]
    order = sorted(distant, key=lambda i: (i if i % 3 else -1, i))
    got = [int(r["node_id"][:2], 16) for r in k.prune_distant(nodes, "0" * 40, 0.33, 1000).collect()]
    assert got == order[: int(len(distant) * 0.33)]
    assert k.prune_distant(nodes, "0" * 40, 1.0, 7).count() == 7
    with pytest.raises(ValueError):
        k.prune_distant(nodes, "0" * 40, 1.5, 7)


def test_failures_since_sighting(spark):
    rng = random.Random(2)
    rows = [(f"n{0 if rng.random() < 0.4 else rng.randrange(40)}", rng.randrange(300), i, rng.choice(["seen", "failed", "failed"])) for i in range(900)]
    df = spark.createDataFrame(rows, "node_id string, at bigint, seq bigint, kind string").repartition(4)
    got = {r["node_id"]: (r["fail_count"], r["evicted"]) for r in k.evict_failed(df, ["at", "seq"]).collect()}
    state = {}
    for node, _, _, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "seen":
            state[node] = 0
        elif node in state:
            state[node] += 1
    assert got == {n: (f, f >= 3) for n, f in state.items()}


def test_merge_nodes(spark):
    base = spark.createDataFrame([("a", 5, 2), ("b", 9, 1)], "node_id string, last_seen bigint, fail_count int")
    new = spark.createDataFrame([("a", 7), ("a", 6), ("b", 3), ("c", 1)], "node_id string, last_seen bigint")
    touched = {tuple(r) for r in k.merge_nodes(base, new, True).collect()}
    assert touched == {("a", 7, 0), ("b", 9, 0), ("c", 1, 0)}
    assert {tuple(r) for r in k.merge_nodes(base, new, False).collect()} == {("a", 5, 2), ("b", 9, 1), ("c", 1, 0)}


def test_failure_rules(spark):
    reasons = ["connect timeout", "connection reset", "bad handshake", "info_hash mismatch", "no extension support", "no ut_metadata", "metadata rejected", "hash verification failed", "other", None]
    df = spark.createDataFrame([(r,) for r in reasons], "r string")
    assert [r[0] for r in df.select(p.classify_failure(F.col("r"))).collect()] == [
        "timeout", "connect", "handshake", "handshake", "no_support", "no_support", "rejected", "hash_mismatch", None, None,
    ]


def test_store_stats_without_rows(spark):
    peers = spark.createDataFrame([], "key int, ip int")
    lookups = spark.createDataFrame([], "hit boolean")
    assert p.store_stats(peers, lookups).first().asDict() == {"total_keys": 0, "total_peers": 0, "hits": 0, "misses": 0, "avg_peers": 0.0, "hit_rate": 0.0}


def refresh_model(requests, answers, seconds):
    out = {}
    for rid, key, at, done, done2 in requests:
        end = min(done if done is not None else at + seconds, at + seconds)
        late = done is None or done > at + seconds
        peers = sum(n for h, t, n in answers if h == key and at <= t <= end)
        retried = peers == 0 and not late
        if retried:
            end2 = min(done2 if done2 is not None else end + seconds, end + seconds)
            late = done2 is None or done2 > end + seconds
            peers = sum(n for h, t, n in answers if h == key and end < t <= end2)
        out[rid] = (peers, late, retried)
    return out


def refresh_rows(seed, n=300):
    rng = random.Random(seed)
    requests, answers = [], []
    for i in range(n):
        at = rng.randrange(400)
        done = rng.choice([None, at + rng.randrange(12)])
        requests.append((i, f"h{rng.randrange(6)}", at, done, rng.choice([None, at + 8 + rng.randrange(14)])))
        answers += [(f"h{0 if rng.random() < 0.4 else rng.randrange(6)}", rng.randrange(400), rng.randrange(4)) for _ in range(2)]
    return requests, answers


def test_refresh_model(spark):
    requests, answers = refresh_rows(9)
    q = spark.createDataFrame(requests, "request_id bigint, info_hash string, at bigint, done_at bigint, retry_done_at bigint")
    a = spark.createDataFrame(answers, "info_hash string, at bigint, peers bigint")
    rows = p.refresh_report(q, a, 8).collect()
    assert {r["request_id"]: (r["total_peers"], r["timed_out"], r["retry_attempted"]) for r in rows} == refresh_model(requests, answers, 8)
    assert {r["note"] for r in rows} >= {"warning: timed out without peers", "warning: timed out with a partial count", "info: found on retry", None}


def test_choose_partition_model(spark):
    rng = random.Random(6)
    for _ in range(4):
        n, dead_after, capacity = 6, 3, 7
        workers = [(i, rng.randrange(n), rng.randrange(n), rng.choice([0.0, 0.5, 1.0, 2.0])) for i in range(30)]
        streaks = [rng.randrange(4) for _ in range(n)]
        df = spark.createDataFrame(workers, "worker_id int, partition_index int, home int, rate double")
        streak = F.array(*map(F.lit, streaks))
        parts = m.partition_rates(df, n).withColumn("streak", F.element_at(streak, F.col("partition_index") + 1))
        rows = m.choose_partition(df, parts, 0.6, dead_after, capacity).collect()
        held = {q: [w[3] for w in workers if w[1] == q] for q in range(n)}
        avg = {q: sum(v) / len(v) if v else 0.0 for q, v in held.items()}
        for r in rows:
            wid, part, home, rate = workers[r["worker_id"]]
            new = streaks[part] + 1 if rate < 0.6 else 0
            wanted = part
            if new >= dead_after and part != home:
                wanted = home
            elif new >= dead_after:
                fits = [q for q in range(n) if q != part and streaks[q] < dead_after and len(held[q]) < capacity]
                wanted = min(fits, key=lambda q: (-avg[q], q), default=part)
            assert (r["new_streak"], r["next_partition"]) == (new, wanted)


def test_rolling_hour_and_hour_count(spark):
    minutes = spark.createDataFrame([(100, 2), (101, 1), (159, 5), (160, 1), (300, 4)], "minute bigint, n bigint")
    assert {r["minute"]: r["last_hour"] for r in m.rolling_hour(minutes).collect()} == {100: 2, 101: 3, 159: 8, 160: 7, 300: 4}
    assert m.hourly_count(minutes, 160).first()[0] == 7 and m.hourly_count(minutes, 1000).first()[0] == 0


def test_health(spark):
    df = spark.createDataFrame([(9, 0), (10, 600), (49, 601), (50, 9999)], "n int, since int")
    rows = [tuple(r["h"]) for r in df.select(m.health(F.col("n"), F.col("since")).alias("h")).collect()]
    assert rows == [("critical", True), ("warning", False), ("warning", True), ("ok", False)]
