"""Peer and attempt queries P1-P13. Observations come from events: one address per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.operators import peers as p
from contentlake.plans.registry import over, query
from contentlake.plans.text import ADDRESSES
from contentlake.sources.tables import Lake

NOW = 1_706_572_800  # 2024-01-30 00:00:00 UTC
DAY = 86_400

# few addresses per user, so that they repeat; some private, some without a port
OBSERVED = """SELECT user_id AS key, CASE event_id % 11 WHEN 0 THEN 167772161 WHEN 1 THEN 0 ELSE 16909060 + event_id % 7 END AS ip,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE 6881 + event_id % 3 END AS port, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events"""


def observed(lake: Lake):
    n = F.col("event_id")
    return lake.events.select(
        F.col("user_id").alias("key"),
        F.when(n % 11 == 0, 167772161).when(n % 11 == 1, 0).otherwise(16909060 + n % 7).alias("ip"),
        F.when(n % 13 == 0, 0).otherwise(6881 + n % 3).alias("port"),
        F.unix_timestamp("ts").alias("at"),
    )


LISTS = f""", l AS (SELECT key, ip, port, max(sec) AS sec FROM o WHERE {NOW} - sec <= {10 * DAY} GROUP BY ALL),
u AS (SELECT key FROM l GROUP BY key ORDER BY max(sec) DESC, key LIMIT 100),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY sec DESC, ip, port) AS INT) AS rank FROM l)
"""


def lists(lake: Lake):
    return p.peer_lists(observed(lake), NOW, 10 * DAY, 8, 100)


@query("p1_peer_lists", over(o=OBSERVED) + LISTS + """
SELECT key, ip, port, sec AS seen_at, rank FROM r WHERE rank <= 8 AND key IN (SELECT key FROM u)
""")
def peer_lists(lake: Lake):
    return lists(lake).withColumnRenamed("at", "seen_at")


@query("p2_peer_counts", over(o=OBSERVED) + """
SELECT key, least(count(DISTINCT (ip, port)), 50) AS peers FROM o WHERE ip <> 0 AND ip <> 4294967295 AND port <> 0 GROUP BY key
""")
def peer_counts(lake: Lake):
    return p.peer_counts(observed(lake))


@query("p3_expire", over(o=OBSERVED) + f"SELECT key, ip, port, sec AS seen_at FROM o WHERE {NOW} - sec <= {3 * DAY}")
def expire(lake: Lake):
    return p.expire(observed(lake), NOW, 3 * DAY).withColumnRenamed("at", "seen_at")


@query("p3_expire_counts", over(o=OBSERVED) + f"""
SELECT count(CASE WHEN {NOW} - sec <= {3 * DAY} THEN 1 END) AS kept, count(CASE WHEN {NOW} - sec > {3 * DAY} THEN 1 END) AS expired FROM o
""")
def expire_counts(lake: Lake):
    return p.expire_counts(observed(lake), NOW, 3 * DAY)


@query("p4_store_stats", over(o=OBSERVED) + LISTS + """
, k AS (SELECT * FROM r WHERE rank <= 8 AND key IN (SELECT key FROM u)),
h AS (SELECT count(CASE WHEN o_custkey IN (SELECT key FROM k) THEN 1 END) AS hits, count(CASE WHEN o_custkey NOT IN (SELECT key FROM k) THEN 1 END) AS misses FROM orders)
SELECT (SELECT count(DISTINCT key) FROM k) AS total_keys, (SELECT count(*) FROM k) AS total_peers, hits, misses,
  round((SELECT count(*)::DOUBLE / count(DISTINCT key) FROM k), 6) AS avg_peers, round(hits * 100.0::DOUBLE / (hits + misses), 6) AS hit_rate FROM h
""")
def store_stats(lake: Lake):
    held = lists(lake)
    keys = held.select("key").distinct().withColumn("hit", F.lit(True))
    asked = lake.orders.select(F.col("o_custkey").alias("key")).join(keys, "key", "left")
    return p.store_stats(held, asked.select(F.coalesce("hit", F.lit(False)).alias("hit")))


@query("p5_ready_keys", over(a=ADDRESSES) + """
SELECT user_id AS key, least(count(*), 50) AS peers FROM a WHERE ip <> 0 AND port <> 0 AND ip & 4278190080 <> 167772160 AND ip & 4294901760 <> 3232235520
  AND ip & 4293918720 <> 2886729728 AND ip & 4278190080 <> 2130706432 GROUP BY user_id HAVING count(*) >= 10
""")
def ready_keys(lake: Lake):
    return p.ready_keys(lake.sql(ADDRESSES).withColumnRenamed("user_id", "key"))


# retry entries: one per order
ENTRIES = f"""SELECT o_orderkey AS key, o_orderkey % 5 AS attempts, o_custkey % 20 AS peers, o_orderstatus = 'P' AS in_progress,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {NOW} - 500 + o_orderkey % 1000 END AS due_at, {NOW} - o_orderkey % 120 AS created_at,
  o_orderstatus = 'F' AS complete, o_orderkey % 7 = 0 AS timed_out FROM orders"""


def entries(lake: Lake):
    n = F.col("o_orderkey")
    return lake.orders.select(
        n.alias("key"), (n % 5).alias("attempts"), (F.col("o_custkey") % 20).alias("peers"), (F.col("o_orderstatus") == "P").alias("in_progress"),
        F.when(n % 3 != 0, NOW - 500 + n % 1000).alias("due_at"), (NOW - n % 120).alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("complete"), (n % 7 == 0).alias("timed_out"),
    )


@query("p6_should_retry", over(e=ENTRIES) + "SELECT key, attempts < 3 AND peers < 10 AND NOT in_progress AS retry FROM e")
def should_retry(lake: Lake):
    decision = p.should_retry(F.col("attempts"), F.col("peers"), F.col("in_progress"))
    return entries(lake).select("key", decision.alias("retry"))


@query("p7_due_retries", over(e=ENTRIES) + f"""
, taken AS (SELECT key FROM e WHERE due_at IS NOT NULL AND due_at <= {NOW} ORDER BY due_at, key LIMIT 100)
SELECT key, CASE WHEN key IN (SELECT key FROM taken) THEN NULL ELSE due_at END AS due_at, in_progress OR key IN (SELECT key FROM taken) AS in_progress FROM e
""")
def due_retries(lake: Lake):
    _, after = p.due_retries(entries(lake), NOW)
    return after.select("key", "due_at", "in_progress")


@query("p7_due_at", over(e=ENTRIES) + "SELECT key, created_at AS soon, created_at + 2 AS later FROM e")
def due_at(lake: Lake):
    made = F.col("created_at")
    return entries(lake).select("key", p.retry_due_at(made, 300).alias("soon"), p.retry_due_at(made, 2900).alias("later"))


@query("p8_retry_stats", """
WITH t AS (SELECT l_orderkey AS key, count(*) AS attempts, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS peers FROM lineitem GROUP BY l_orderkey),
c AS (SELECT count(CASE WHEN peers > 0 AND attempts = 1 THEN 1 END) AS success_first, count(CASE WHEN peers > 0 AND attempts = 2 THEN 1 END) AS success_second,
  count(CASE WHEN peers > 0 AND attempts >= 3 THEN 1 END) AS success_third, count(CASE WHEN peers = 0 THEN 1 END) AS failed_all, CAST(sum(attempts - 1) AS BIGINT) AS retries FROM t),
s AS (SELECT *, success_first + success_second + success_third + failed_all AS done FROM c)
SELECT success_first, success_second, success_third, failed_all, retries, round(success_first * 100.0::DOUBLE / done, 6) AS first_percent,
  round(success_second * 100.0::DOUBLE / done, 6) AS second_percent, round(success_third * 100.0::DOUBLE / done, 6) AS third_percent,
  round(failed_all * 100.0::DOUBLE / done, 6) AS failed_percent, round((success_second + success_third) * 100.0::DOUBLE / retries, 6) AS retry_efficiency FROM s
""")
def retry_stats(lake: Lake):
    tries = lake.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("peers")
    )
    return p.retry_stats(tries)


@query("p9_cleanup", over(e=ENTRIES) + f"SELECT key FROM e WHERE {NOW} - created_at <= 60")
def cleanup(lake: Lake):
    return p.cleanup_old(entries(lake), NOW, 60).select("key")


@query("p9_cleanup_requests", over(e=ENTRIES) + f"SELECT key FROM e WHERE NOT ({NOW} - created_at > 60 AND (complete OR timed_out))")
def cleanup_requests(lake: Lake):
    return p.cleanup_old(entries(lake), NOW, 60, only_finished=True).select("key")


CLASS = """CASE WHEN contains(close_reason, 'timeout') THEN 'timeout' WHEN contains(close_reason, 'connect') THEN 'connect'
  WHEN contains(close_reason, 'handshake') OR contains(close_reason, 'info_hash mismatch') THEN 'handshake'
  WHEN contains(close_reason, 'no extension support') OR contains(close_reason, 'ut_metadata') THEN 'no_support'
  WHEN contains(close_reason, 'rejected') THEN 'rejected' WHEN contains(close_reason, 'hash') THEN 'hash_mismatch' END"""


@query("p10_failure_class", over("attempts") + f"SELECT event_id, close_reason, {CLASS} AS class FROM attempts")
def failure_class(lake: Lake):
    return lake.attempts.select("event_id", "close_reason", p.classify_failure(F.col("close_reason")).alias("class"))


@query("p11_attempt_rollup", over("attempts", c=f"SELECT *, {CLASS} AS class, CAST(event_id % 7 AS INT) AS state, CAST(epoch_us(ts) AS BIGINT) AS us FROM attempts") + """
SELECT info_hash, count(*) AS tried, count(CASE WHEN class = 'timeout' THEN 1 END) AS timeout, count(CASE WHEN class = 'connect' THEN 1 END) AS connect,
  count(CASE WHEN class = 'handshake' THEN 1 END) AS handshake, count(CASE WHEN class = 'no_support' THEN 1 END) AS no_support,
  count(CASE WHEN class = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN class = 'hash_mismatch' THEN 1 END) AS hash_mismatch,
  max(state) AS furthest_state, min(us) AS first_at, max(us) AS last_at FROM c GROUP BY info_hash
""")
def attempt_rollup(lake: Lake):
    connections = lake.attempts.select(
        "info_hash", "close_reason", (F.col("event_id") % 7).cast("int").alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    return p.attempt_rollup(connections)


@query("p12_first_success", over("attempts") + """
SELECT info_hash, arg_min(event_id, (ts, event_id)) FILTER (outcome = 'fetched') AS event_id, count(*) - 1 AS closed_others FROM attempts GROUP BY info_hash
HAVING count(CASE WHEN outcome = 'fetched' THEN 1 END) > 0
""")
def first_success(lake: Lake):
    return p.first_success(lake.attempts.withColumnRenamed("ts", "at")).select("info_hash", "event_id", "closed_others")


# requests: signups, done after a few seconds or never; answers: every event of the user in minutes
REQUESTS = """SELECT event_id AS request_id, sha1(CAST(user_id AS VARCHAR)) AS info_hash, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS sec,
  CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) // 60 + 200 WHEN 1 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) // 60 + 3 END AS done,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) // 60 + 250 END AS done2 FROM events WHERE event_type = 'signup'"""
ANSWERS = """SELECT sha1(CAST(user_id AS VARCHAR)) AS info_hash, CAST(floor(epoch(ts)) AS BIGINT) // 60 AS sec, event_id % 4 AS peers FROM events WHERE event_type <> 'signup'"""
WAIT = 240


@query("p13_refresh_report", over(q=REQUESTS, a=ANSWERS) + f"""
, w AS (SELECT *, least(coalesce(done, sec + {WAIT}), sec + {WAIT}) AS e1, done IS NULL OR done > sec + {WAIT} AS late FROM q),
v AS (SELECT *, least(coalesce(done2, e1 + {WAIT}), e1 + {WAIT}) AS e2, done2 IS NULL OR done2 > e1 + {WAIT} AS late2 FROM w),
s AS (SELECT v.*, coalesce((SELECT sum(peers) FROM a WHERE a.info_hash = v.info_hash AND a.sec BETWEEN v.sec AND v.e1), 0) AS p1,
      coalesce((SELECT sum(peers) FROM a WHERE a.info_hash = v.info_hash AND a.sec > v.e1 AND a.sec <= v.e2), 0) AS p2 FROM v),
t AS (SELECT *, p1 = 0 AND NOT late AS again, CAST(CASE WHEN p1 = 0 AND NOT late THEN p2 ELSE p1 END AS BIGINT) AS total_peers, CASE WHEN p1 = 0 AND NOT late THEN late2 ELSE late END AS timed_out FROM s)
SELECT request_id, info_hash, total_peers, timed_out, again AS retry_attempted, CASE WHEN timed_out AND total_peers = 0 AND again THEN 'warning: both timed out without peers'
  WHEN timed_out AND total_peers = 0 THEN 'warning: timed out without peers' WHEN timed_out THEN 'warning: timed out with a partial count'
  WHEN again AND total_peers > 0 THEN 'info: found on retry' END AS note FROM t
""")
def refresh_report(lake: Lake):
    minute, n = F.floor(F.unix_timestamp("ts") / 60), F.col("event_id")
    keyed = lake.events.withColumn("info_hash", F.sha1(F.col("user_id").cast("string"))).withColumn("at", minute)
    requests = keyed.filter("event_type = 'signup'").select(
        n.alias("request_id"), "info_hash", "at",
        F.when(n % 4 == 0, F.col("at") + 200).when(n % 4 != 1, F.col("at") + 3).alias("done_at"),
        F.when(n % 2 == 0, F.col("at") + 250).alias("retry_done_at"),
    )
    answers = keyed.filter("event_type != 'signup'").select("info_hash", "at", (n % 4).alias("peers"))
    return p.refresh_report(requests, answers, WAIT)
