"""Operational time-series queries M1-M17 on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.operators import contentfilter as cf
from contentlake.operators import dedup
from contentlake.operators import keyspace as ks
from contentlake.operators import monitor as m
from contentlake.plans.filtering import LIGHT, STATS, decided
from contentlake.plans.ingest import STRIKES
from contentlake.plans.keyspace import CENTER, C, byte_sql
from contentlake.plans.peers import CLASS
from contentlake.plans.registry import over, query
from contentlake.plans.text import PATTERNS
from contentlake.sources.tables import Lake

MINUTES = "SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1"


@query("m1_minute_counts", MINUTES)
def minute_counts(lake: Lake):
    return m.minute_counts(lake.events)


@query("m1_minute_counts_by_type", """
SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY ALL
""")
def minute_counts_by_type(lake: Lake):
    return m.minute_counts(lake.events, keys=("event_type",))


NOW_MINUTE = 28_420_000  # 2024-01-14 02:40 UTC


@query("m2_hourly_count", over(c=MINUTES) + f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS last_hour FROM c WHERE minute <= {NOW_MINUTE} AND {NOW_MINUTE} - minute < 60")
def hourly_count(lake: Lake):
    return m.hourly_count(m.minute_counts(lake.events), NOW_MINUTE)


@query("m2_rolling_hour", over(c=MINUTES) + """
SELECT minute, n, CAST(sum(n) OVER (ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM c
""")
def rolling_hour(lake: Lake):
    return m.rolling_hour(m.minute_counts(lake.events))


STEP = 6 * 3600
READINGS = f"""SELECT user_id, (slot + 1) * {STEP} AS sec, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY slot) AS BIGINT) AS n FROM
  (SELECT user_id, CAST(floor(epoch(ts) / {STEP}) AS BIGINT) AS slot, count(*) AS k FROM events GROUP BY ALL)"""
RATES = """SELECT user_id, sec, n, n - lag(n) OVER w AS dn, sec - lag(sec) OVER w AS dt, (n - lag(n) OVER w)::DOUBLE / (sec - lag(sec) OVER w) AS rate
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY sec)"""


def user_rates(lake: Lake):
    return m.interval_rate(m.interval_counts(lake.events, "user_id", "ts", STEP), "user_id")


@query("m3_interval_rate", over(r=READINGS, q=RATES) + "SELECT user_id, sec AS reading, n, round(rate * 3600, 6) AS per_hour FROM q")
def interval_rate(lake: Lake):
    return user_rates(lake).select("user_id", F.col("at").alias("reading"), "n", F.round(F.col("rate") * 3600, 6).alias("per_hour"))


def ema_sql(source: str, key: str, order: str, x: str) -> str:
    """The running average as a fold over the ordered prefix of each key."""
    return f"""SELECT *, list_reduce(list({x}::DOUBLE) OVER (PARTITION BY {key} ORDER BY {order}), lambda a, b: a * 0.7::DOUBLE + b * 0.3::DOUBLE) AS ema FROM {source}"""


@query("m4_ema", over(r=READINGS, q=RATES, f="SELECT * FROM q WHERE rate IS NOT NULL", e=ema_sql("f", "user_id", "sec", "rate")) + """
SELECT user_id, sec AS reading, round(ema, 12) AS ema FROM e
""")
def ema(lake: Lake):
    rates = user_rates(lake).filter(F.col("rate").isNotNull())
    return m.ema(rates, "user_id", ["at"], "rate").select("user_id", F.col("at").alias("reading"), F.round("ema", 12).alias("ema"))


@query("m4_ema_values", f"""
WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
e AS (SELECT event_type, event_id, k, value AS ema FROM o WHERE k = 1
      UNION ALL SELECT o.event_type, o.event_id, o.k, o.value * 0.3::DOUBLE + e.ema * 0.7::DOUBLE FROM e JOIN o ON o.event_type = e.event_type AND o.k = e.k + 1)
SELECT event_id, round(ema, 5) AS ema FROM e
""")
def ema_values(lake: Lake):
    """Five long series: the smoothing runs over all events."""
    smoothed = m.ema(lake.events.select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value")
    return smoothed.select("event_id", F.round("ema", 5).alias("ema"))


LOW, AGE, GRACE = 0.00009, 5 * 86400, 86400


@query("m5_low_rate", over(r=READINGS, q=RATES, b="SELECT user_id, min(sec) AS born FROM r GROUP BY user_id", f="SELECT * FROM q WHERE rate IS NOT NULL",
       e=ema_sql("f", "user_id", "sec", "rate")) + f"""
, l AS (SELECT e.*, sec - born AS age, ema < {LOW}::DOUBLE AND sec - born >= {AGE} AS low,
        first_value(n) OVER g AS n2, first_value(sec) OVER g AS sec2 FROM e JOIN b USING (user_id)
        WINDOW g AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {GRACE} FOLLOWING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, 0.3::DOUBLE * (n2 - n + dn) / (sec2 - sec + dt) + 0.7::DOUBLE * ema AS again FROM l)
SELECT user_id, sec AS reading, age, low, round(CASE WHEN low THEN again END, 10) AS after_grace, coalesce(low AND again < {LOW}::DOUBLE, false) AS shut_down FROM a
""")
def low_rate(lake: Lake):
    out = m.low_rate(user_rates(lake), "user_id", LOW, AGE, GRACE)
    return out.select("user_id", F.col("at").alias("reading"), "age", "low", F.round("ema_after_grace", 10).alias("after_grace"), "shut_down")


@query("m7_hysteresis", """
SELECT event_id, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS "on" FROM events
""")
def hysteresis(lake: Lake):
    rows = lake.events.select("event_id", "event_type", "ts", "value")
    return m.hysteresis(rows, "event_type", ["ts", "event_id"], "value", 60, 20).select("event_id", "on")


@query("m8_low_streak", """
WITH o AS (SELECT event_id, event_type, value < 50 AS low, row_number() OVER w AS k, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, CAST(k - coalesce(max(CASE WHEN NOT low THEN k END) OVER (PARTITION BY event_type ORDER BY k), 0) AS BIGINT) AS streak FROM o
""")
def low_streak(lake: Lake):
    rows = lake.events.select("event_id", "event_type", "ts", "value")
    return m.low_streak(rows, "event_type", ["ts", "event_id"], F.col("value") < 50).select("event_id", "streak")


# workers: customers on 32 partitions with a rate from their balance
WORKERS = """SELECT c_custkey AS worker_id, CAST(c_custkey % 30 AS INT) AS p, CASE WHEN c_custkey % 4 = 0 THEN CAST((c_custkey + 1) % 30 AS INT) ELSE CAST(c_custkey % 30 AS INT) END AS home,
  floor(abs(c_acctbal)) / 1024 AS rate FROM customer"""
PARTS = """SELECT i AS p, coalesce(a, 0) AS avg_rate, coalesce(k, 0) AS workers, CAST(i % 6 AS BIGINT) AS streak FROM (SELECT CAST(unnest(range(32)) AS INT) AS i)
  LEFT JOIN (SELECT p, avg(rate) AS a, count(*) AS k FROM w GROUP BY p) ON i = p"""


def workers(lake: Lake):
    n = F.col("c_custkey")
    own = (n % 30).cast("int")
    return lake.customer.select(
        n.alias("worker_id"), own.alias("partition_index"), F.when(n % 4 == 0, ((n + 1) % 30).cast("int")).otherwise(own).alias("home"),
        (F.floor(F.abs("c_acctbal")) / 1024).alias("rate"),
    )


@query("m9_partition_rates", over(w=WORKERS, parts=PARTS) + "SELECT p AS partition_index, round(avg_rate, 6) AS avg_rate, workers FROM parts")
def partition_rates(lake: Lake):
    return m.partition_rates(workers(lake), 32).withColumn("avg_rate", F.round("avg_rate", 6))


@query("m10_choose_partition", over(w=WORKERS, parts=PARTS) + """
, cand AS (SELECT p, row_number() OVER (ORDER BY avg_rate DESC, p) AS k FROM parts WHERE streak < 5 AND workers < 1000000),
s AS (SELECT w.*, CASE WHEN rate < 4 THEN streak + 1 ELSE 0 END AS new_streak FROM w JOIN parts USING (p))
SELECT worker_id, new_streak, new_streak >= 5 AS dead, new_streak >= 5 AND p <> home AS reset_home_streak,
  CASE WHEN new_streak < 5 THEN p WHEN p <> home THEN home ELSE coalesce((SELECT arg_min(c.p, c.k) FROM cand c WHERE c.p <> s.p), p) END AS next_partition FROM s
""")
def choose_partition(lake: Lake):
    rows = workers(lake)
    parts = m.partition_rates(rows, 32).withColumn("streak", (F.col("partition_index") % 6).cast("bigint"))
    out = m.choose_partition(rows, parts, 4.0, 5, 1_000_000)
    return out.select("worker_id", "new_streak", "dead", "reset_home_streak", "next_partition")


@query("m11_rates", over("attempts", c=f"SELECT *, {CLASS} AS class FROM attempts") + """
, k AS (SELECT info_hash, count(CASE WHEN outcome <> 'observed' THEN 1 END) AS attempts, count(*) AS initiated, count(CASE WHEN outcome = 'fetched' THEN 1 END) AS ok,
  count(CASE WHEN outcome = 'filtered' THEN 1 END) AS fl, count(CASE WHEN class = 'timeout' THEN 1 END) AS tm FROM c GROUP BY info_hash)
SELECT info_hash, attempts, round(CASE WHEN attempts > 0 THEN ok * 100.0::DOUBLE / attempts ELSE 0 END, 6) AS success_rate,
  round(CASE WHEN attempts > 0 THEN fl * 100.0::DOUBLE / attempts ELSE 0 END, 6) AS filter_rate, round(tm * 100.0::DOUBLE / initiated, 6) AS timeout_rate FROM k
""")
def rates(lake: Lake):
    return m.rates(lake.attempts, "info_hash")


@query("m12_cumulative", """
SELECT CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS rows_seen FROM lineitem
""")
def cumulative(lake: Lake):
    rows = lake.lineitem.select("l_linestatus", F.col("l_linenumber").cast("bigint").alias("lines"), F.lit(1).cast("bigint").alias("rows_seen"))
    done, live = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus != 'F'")
    return m.cumulative(done, live, ["lines", "rows_seen"])


FUNNEL = """SELECT count(CASE WHEN outcome <> 'observed' THEN 1 END) AS total_attempts, count(*) AS connections_initiated,
  count(CASE WHEN class = 'connect' THEN 1 END) AS connections_failed, count(CASE WHEN class = 'timeout' THEN 1 END) AS connections_timeout,
  count(CASE WHEN class = 'handshake' THEN 1 END) AS handshake_failed, count(CASE WHEN class = 'no_support' THEN 1 END) AS no_metadata_support,
  count(CASE WHEN class = 'rejected' THEN 1 END) AS metadata_rejected, count(CASE WHEN class = 'hash_mismatch' THEN 1 END) AS hash_mismatch,
  count(CASE WHEN outcome = 'fetched' THEN 1 END) AS fetched, count(CASE WHEN outcome = 'filtered' THEN 1 END) AS filtered FROM c"""


@query("m13_fetch_stats", over("attempts", c=f"SELECT *, {CLASS} AS class FROM attempts", s=FUNNEL) + """
SELECT *, round(fetched * 100.0::DOUBLE / total_attempts, 6) AS success_rate_percent, round(filtered * 100.0::DOUBLE / total_attempts, 6) AS filter_rate_percent,
  round(connections_timeout * 100.0::DOUBLE / connections_initiated, 6) AS timeout_rate_percent FROM s
""")
def fetch_stats(lake: Lake):
    return m.fetch_stats(lake.attempts)


@query("m14_group_report", over("attempts") + """
, q AS (SELECT info_hash, count(CASE WHEN outcome = 'observed' THEN 1 END) AS size FROM attempts GROUP BY info_hash)
SELECT a.info_hash, count(CASE WHEN outcome = 'fetched' THEN 1 END) AS fetched, count(CASE WHEN outcome = 'filtered' THEN 1 END) AS filtered,
  count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed, max(q.size) AS queue_size, 3000 AS queue_capacity, 25 AS pause_threshold, 10 AS resume_threshold, max(q.size) >= 25 AS paused
FROM attempts a JOIN q USING (info_hash) GROUP BY a.info_hash
""")
def group_report(lake: Lake):
    waiting = F.count(F.when(F.col("outcome") == "observed", 1))
    queues = lake.attempts.groupBy("info_hash").agg(waiting.alias("queue_size"), (waiting >= 25).alias("paused"))
    return m.group_report(lake.attempts, queues, "info_hash", 3000, 25, 10)


REPORT_NOW, REPORT_START = 1_706_572_800, 1_703_980_801


@query("m15_stats_report", decided(LIGHT, 8, 10, 7) + f""", stats AS ({STATS}), a AS (SELECT * FROM (WITH attempts AS (
  SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'fetched' WHEN 'signup' THEN 'filtered' ELSE 'observed' END AS outcome FROM events)
  SELECT count(CASE WHEN outcome <> 'observed' THEN 1 END) AS total_attempts, count(CASE WHEN outcome = 'fetched' THEN 1 END) AS fetched FROM attempts))
SELECT '0.1' AS version, CAST({REPORT_NOW} AS BIGINT) AS timestamp, '719:59' AS uptime, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM item_files) AS files,
  stats.total_filtered, stats.filtered_by_keyword, a.total_attempts, a.fetched,
  (SELECT count(*) FROM customer WHERE {byte_sql('sha1(CAST(c_custkey AS VARCHAR))', C)} > 128) AS distant FROM stats, a
""")
def stats_report(lake: Lake):
    filtered = cf.filter_stats(cf.filter_content(lake.items, lake.item_files, LIGHT, PATTERNS, 8, 10, 7))
    sections = {
        "catalog": dedup.catalog_totals(lake.items, lake.item_files),
        "filter": filtered,
        "fetcher": m.fetch_stats(lake.attempts),
        "keyspace": ks.distance_split(lake.nodes, CENTER),
    }
    report = m.stats_report(sections, "0.1", REPORT_NOW, REPORT_START)

    def field(path: str, kind: str = "bigint"):
        return F.get_json_object("json", f"$.{path}").cast(kind)

    return report.select(
        field("version", "string").alias("version"), field("timestamp").alias("timestamp"), field("uptime", "string").alias("uptime"),
        field("catalog.items").alias("items"), field("catalog.files").alias("files"),
        field("filter.total_filtered").alias("total_filtered"), field("filter.filtered_by_keyword").alias("filtered_by_keyword"),
        field("fetcher.total_attempts").alias("total_attempts"), field("fetcher.fetched").alias("fetched"), field("keyspace.distant_nodes").alias("distant"),
    )


LATE = 1_706_400_000


@query("m15_full_report", over("attempts", w=WORKERS, parts=PARTS) + STRIKES + f"""
, g AS (SELECT substr(info_hash, 1, 1) AS g, count(CASE WHEN outcome = 'fetched' THEN 1 END) AS fetched, count(CASE WHEN outcome = 'filtered' THEN 1 END) AS filtered,
        count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed, count(CASE WHEN outcome = 'observed' THEN 1 END) AS waiting FROM attempts GROUP BY 1),
o AS (SELECT count(CASE WHEN outcome = 'fetched' THEN 1 END) AS fetched, count(CASE WHEN outcome <> 'observed' THEN 1 END) AS tried FROM attempts)
SELECT (SELECT count(*) FROM events WHERE floor(epoch(ts) / 60) BETWEEN {LATE // 60 - 59} AND {LATE // 60}) AS last_hour,
  (SELECT count(CASE WHEN first_strike THEN 1 END) FROM s) AS first_strikes, (SELECT count(CASE WHEN second_strike THEN 1 END) FROM s) AS second_strikes,
  (SELECT least(100, count(DISTINCT info_hash)) FROM attempts) AS cached_nodes, 100 AS capacity, 17 AS submit_percent,
  (SELECT string_agg(g || ':' || fetched || ':' || filtered || ':' || failed || ':' || waiting || ':' || (waiting >= 25)::VARCHAR, ' ' ORDER BY g) FROM g) AS groups,
  (SELECT string_agg(p || ':' || workers || ':' || CAST(round(avg_rate * 1000) AS BIGINT), ' ' ORDER BY p) FROM parts) AS partitions,
  o.fetched AS total_fetched, o.tried AS total_attempts, round(o.fetched * 100.0::DOUBLE / o.tried, 6) AS success_rate_percent FROM o
""")
def full_report(lake: Lake):
    """The sections that ``m15_stats_report`` has not: last hour, strikes, cache, groups, partitions, totals; read back from the JSON."""
    attempts = lake.attempts.withColumn("g", F.substring("info_hash", 1, 1))
    waiting = F.count(F.when(F.col("outcome") == "observed", 1))
    queues = attempts.groupBy("g").agg(waiting.alias("queue_size"), (waiting >= 25).alias("paused"))
    sections = {
        "hour": m.hour_section(lake.events, LATE),
        "strikes": dedup.strike_totals(dedup.two_strike(lake.attempts)),
        "cache": m.cache_section(dedup.fifo_cache(lake.attempts, "info_hash", "ts", 100), 100),
        "aggregate": m.aggregate_section(attempts),
    }
    lists = {
        "groups": m.as_list(m.group_report(attempts, queues, "g", 3000, 25, 10), "groups", "g"),
        "partitions": m.as_list(m.partition_rates(workers(lake), 32), "partitions", "partition_index"),
    }
    schema = """hour struct<last_hour:bigint>, strikes struct<first_strikes:bigint,second_strikes:bigint>, cache struct<cached_nodes:bigint,capacity:int,submit_percent:int>,
        aggregate struct<total_fetched:bigint,total_attempts:bigint,success_rate_percent:double>,
        groups array<struct<g:string,fetched:string,filtered:string,failed:string,queue_size:string,paused:string>>,
        partitions array<struct<partition_index:string,workers:string,avg_rate:double>>"""
    read = m.stats_report(sections, "0.1", REPORT_NOW, REPORT_START, lists).select(F.from_json("json", schema).alias("r"))

    def joined(name: str, *fields):
        return F.array_join(F.transform(F.col(f"r.{name}"), lambda e: F.concat_ws(":", *[f(e) if callable(f) else e[f] for f in fields])), " ").alias(name)

    return read.select(
        "r.hour.last_hour", "r.strikes.first_strikes", "r.strikes.second_strikes", "r.cache.*",
        joined("groups", "g", "fetched", "filtered", "failed", "queue_size", "paused"),
        joined("partitions", "partition_index", "workers", lambda e: F.round(e["avg_rate"] * 1000).cast("bigint").cast("string")), "r.aggregate.*",
    )


@query("m16_health", """
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, max(c_custkey) AS since FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, n, CASE WHEN n < 10 THEN 'critical' WHEN n < 50 THEN 'warning' ELSE 'ok' END AS status, n < 10 OR (n < 50 AND since > 600) AS action_due FROM g
""")
def health(lake: Lake):
    groups = lake.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("since"))
    return groups.withColumn("h", m.health(F.col("n"), F.col("since"))).select("c_nationkey", "c_mktsegment", "n", "h.status", "h.action_due")


@query("m17_utilisation", """
SELECT p_brand, round(count(*) * 100.0::DOUBLE / 4000, 6) AS queue_percent, round(CASE WHEN max(p_size) > 1 THEN count(*) * 100.0::DOUBLE / (max(p_size) - 1) ELSE 0 END, 6) AS pool_percent FROM part GROUP BY p_brand
""")
def utilisation(lake: Lake):
    groups = lake.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("used"), (F.max("p_size") - 1).alias("size"))
    return groups.select(
        "p_brand", m.utilisation(F.col("used"), F.lit(4000)).alias("queue_percent"), m.utilisation(F.col("used"), F.col("size")).alias("pool_percent")
    )
