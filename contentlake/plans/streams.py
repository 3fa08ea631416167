"""Streaming queries Z1-Z8: the stream over all events must agree with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.operators.monitor import interval_counts
from contentlake.plans.ingest import STRIKES
from contentlake.plans.monitor import AGE, GRACE, LOW, RATES, READINGS, STEP, ema_sql
from contentlake.plans.peers import ANSWERS, OBSERVED, REQUESTS, WAIT
from contentlake.plans.registry import over, query, scratch
from contentlake.operators.contentfilter import max_keyword_weight
from contentlake.sources.catalogstore import CatalogStore
from contentlake.sources.sinks import read_catalog
from contentlake.sources.tables import Lake
from contentlake.streaming import chain
from contentlake.streaming import processors as sp
from contentlake.streaming import streams as st


def events(lake: Lake):
    """The events file as a stream; TIMESTAMP instead of zoneless times, for the watermark."""
    stream = st.read_events(lake.spark, f"{lake.folder}/events*.parquet", lake.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_batches(lake: Lake, batches: int = 4):
    """The events as a stream of several micro-batches: files of equal spans of time, written one after the other."""
    path, rows = scratch(lake.spark, "events"), lake.events.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).select(F.unix_micros("min(ts)"), F.unix_micros("max(ts)")).first()
    part = F.floor((F.unix_micros("ts") - first) * batches / max(last + 1 - first, 1))
    for k in range(batches):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return st.read_events(lake.spark, path, rows.schema, max_files=1)


def run(lake: Lake, df, mode: str = "append"):
    return st.run_to_end(df, scratch(lake.spark, "stream"), mode)


@query("z1_event_stream", "SELECT event_id, user_id, event_type FROM events")
def event_stream(lake: Lake):
    return run(lake, events(lake).select("event_id", "user_id", "event_type")).drop("epoch")


@query("z2_dedup_stream", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS kept FROM events")
def dedup_stream(lake: Lake):
    first = run(lake, st.dedup_stream(events(lake).select("user_id", "ts"), "user_id", "ts", "60 days"))
    return first.agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("kept"))


CLOSED = "(SELECT epoch(max(ts)) - 600 FROM events)"


@query("z3_minute_counts", "SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_counts(lake: Lake):
    """All minutes, the open ones at the end of the stream with what they hold so far."""
    counts = st.minute_counts_stream(events(lake).select("ts"), "ts", "10 minutes")
    return st.last_update(run(lake, counts.select(st.minute_number().alias("minute"), "n"), "update"), "minute")


@query("z3_minute_counts_by_type", """
SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY ALL
""")
def minute_counts_by_type(lake: Lake):
    counts = st.minute_counts_stream(events(lake).select("ts", "event_type"), "ts", "10 minutes", "event_type")
    every = run(lake, counts.select("event_type", st.minute_number().alias("minute"), "n"), "update")
    return every.groupBy("event_type", "minute").agg(F.max_by("n", "epoch").alias("n"))


@query("z3_rolling_hour", f"""
WITH c AS (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT m + unnest(range(60)) AS minute, n FROM c)
SELECT minute, CAST(sum(n) AS BIGINT) AS last_hour FROM e GROUP BY minute HAVING (minute + 1) * 60 <= {CLOSED}
""")
def rolling_hour(lake: Lake):
    return run(lake, st.rolling_hour_stream(events(lake).select("ts"), "ts", "10 minutes")).drop("epoch")


@query("z3_rolling_hour_by_type", """
WITH c AS (SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT event_type, m + unnest(range(60)) AS minute, n FROM c)
SELECT event_type, minute, CAST(sum(n) AS BIGINT) AS last_hour FROM e GROUP BY ALL
""")
def rolling_hour_by_type(lake: Lake):
    """Every hour with events, open ones included, over several micro-batches."""
    rows = event_batches(lake).select(F.col("event_type").alias("key"), "ts")
    reports = run(lake, sp.hour_stream(rows, "10 minutes"), "update")
    return reports.groupBy(F.col("key").alias("event_type"), "minute").agg(F.max_by("last_hour", "epoch").alias("last_hour"))


@query("z4_drop_seen", """
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0)
""")
def drop_seen(lake: Lake):
    seen = lake.orders.filter("o_orderstatus = 'F' AND o_custkey % 3 = 0").select(F.col("o_custkey").alias("user_id"))
    return run(lake, st.drop_seen_stream(events(lake).select("event_id", "user_id"), seen, "user_id")).drop("epoch")


@query("z4_admit_new", """
SELECT user_id, min(event_id) AS event_id FROM events
WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0) GROUP BY user_id
""")
def admit_new(lake: Lake):
    seen = lake.orders.filter("o_orderstatus = 'F' AND o_custkey % 3 = 0").select(F.col("o_custkey").alias("user_id"))
    path = scratch(lake.spark, "admitted")
    rows = event_batches(lake).select("user_id", "event_id")
    st.admit_new(rows, seen, "user_id", [F.col("event_id")], path, f"{path}/checkpoint", available_now=True).awaitTermination()
    return lake.spark.read.parquet(f"{path}/rows").drop("epoch")


def attempt_rows(lake: Lake):
    outcome = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "fetched")
        .when(F.col("event_type") == "signup", "filtered").otherwise("observed")
    )
    return events(lake).select(
        F.sha1(F.col("user_id").cast("string")).alias("info_hash"), F.unix_micros("ts").alias("at"), "event_id", outcome.alias("outcome")
    )


@query("z5_two_strike", over("attempts") + STRIKES + "SELECT info_hash, first_strike, second_strike, seen_as FROM s WHERE first_strike OR seen_as IS NOT NULL")
def two_strike(lake: Lake):
    return st.last_update(run(lake, sp.strike_stream(attempt_rows(lake)), "update"), "info_hash")


@query("z5_peer_lists", over(o=OBSERVED) + """
, l AS (SELECT key, ip, port, max(sec) AS seen_at FROM o GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY seen_at DESC, ip, port) AS INT) AS rank FROM l QUALIFY rank <= 8
""")
def peer_lists(lake: Lake):
    n = F.col("event_id")
    rows = events(lake).select(
        F.col("user_id").alias("key"), F.when(n % 11 == 0, 167772161).when(n % 11 == 1, 0).otherwise(16909060 + n % 7).alias("ip"),
        F.when(n % 13 == 0, 0).otherwise(6881 + n % 3).alias("port"), F.unix_timestamp("ts").alias("at"),
    )
    listed = run(lake, sp.peer_list_stream(rows, 8), "update")
    newest = listed.groupBy("key").agg(F.max("epoch").alias("epoch"))
    return listed.join(newest, ["key", "epoch"]).select("key", "ip", "port", F.col("at").alias("seen_at"), "rank")


@query("z5_retry_decisions", '''
WITH RECURSIVE r AS (
  SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id * 7 % 14 AS peers,
         row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
s AS (
  SELECT key, k, sec, peers, 0 AS tries, sec AS begun, peers >= 10 AS done FROM r WHERE k = 1
  UNION ALL
  SELECT n.key, n.k, n.sec, n.peers, n.tries, n.begun, n.peers >= 10 OR n.tries >= 3 FROM (
    SELECT r.*, CASE WHEN s.done OR r.sec - s.begun > 86400 THEN 0 ELSE s.tries + 1 END AS tries,
           CASE WHEN s.done OR r.sec - s.begun > 86400 THEN r.sec ELSE s.begun END AS begun
    FROM s JOIN r ON r.key = s.key AND r.k = s.k + 1) n)
SELECT key, sec AS "at", CAST(tries + 1 AS INT) AS attempts, peers, CASE WHEN NOT done THEN 'retry' WHEN peers > 0 THEN 'complete' ELSE 'failed' END AS decision,
       CASE WHEN NOT done THEN sec END AS due_at FROM s
''')
def retry_decisions(lake: Lake):
    n = F.col("event_id")
    rows = events(lake).select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("at"), n, (n * 7 % 14).alias("peers"))
    return run(lake, sp.retry_stream(rows, max_age=86_400), "update").drop("epoch")


@query("z5_node_buckets")
def node_buckets(lake: Lake):
    rows = events(lake).select(
        (F.col("user_id") % 4).cast("int").alias("bucket"), F.sha1(F.col("user_id").cast("string")).alias("node_id"),
        F.unix_timestamp("ts").alias("at"), "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("seen").alias("kind"),
    )
    return run(lake, sp.bucket_stream(rows, cap=10), "update").drop("epoch")


SMOOTHED = over(r=READINGS, q=RATES, b="SELECT user_id, min(sec) AS born FROM r GROUP BY user_id", f="SELECT * FROM q WHERE rate IS NOT NULL",
                e=ema_sql("f", "user_id", "sec", "rate"))


@query("z6_ema_stream", SMOOTHED + f"""
, l AS (SELECT e.*, ema < {LOW}::DOUBLE AND sec - born >= {AGE} AS low, first_value(n) OVER g AS n2, first_value(sec) OVER g AS sec2 FROM e JOIN b USING (user_id)
        WINDOW g AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {GRACE} FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id AS key, sec AS reading, round(ema, 10) AS ema, low, CAST(NULL AS BIGINT) AS shut_down_at FROM l
UNION ALL SELECT user_id, sec, round(0.3::DOUBLE * (n2 - n + dn) / (sec2 - sec + dt) + 0.7::DOUBLE * ema, 10), true, sec2 FROM l
WHERE low AND 0.3::DOUBLE * (n2 - n + dn) / (sec2 - sec + dt) + 0.7::DOUBLE * ema < {LOW}::DOUBLE
""")
def ema_stream(lake: Lake):
    """Counter readings are written once, then read as a stream; their rates are taken inside it."""
    path = scratch(lake.spark, "readings")
    interval_counts(lake.events, "user_id", "ts", STEP).withColumnRenamed("user_id", "key").write.parquet(path)
    readings = st.read_events(lake.spark, path, lake.spark.read.parquet(path).schema)
    out = run(lake, sp.ema_stream(readings, LOW, AGE, GRACE), "update")
    return out.select("key", F.col("at").alias("reading"), F.round("ema", 10).alias("ema"), "low", "shut_down_at")


@query("z7_catalog_sink", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def catalog_sink(lake: Lake):
    path = scratch(lake.spark, "catalog")
    rows = events(lake).select("user_id", "event_type", F.struct("ts", "event_id").alias("added_ts"))
    st.catalog_sink(rows, f"{path}/out", f"{path}/checkpoint", available_now=True).awaitTermination()
    return read_catalog(lake.spark, f"{path}/out", "user_id").select("user_id", "event_type")


@query("z8_refresh_stream", over(q=REQUESTS, a=ANSWERS) + f"""
, w AS (SELECT *, least(coalesce(done, sec + {WAIT}), sec + {WAIT}) AS e1, done IS NULL OR done > sec + {WAIT} AS late FROM q),
v AS (SELECT *, least(coalesce(done2, e1 + {WAIT}), e1 + {WAIT}) AS e2, done2 IS NULL OR done2 > e1 + {WAIT} AS late2 FROM w),
s AS (SELECT v.*, coalesce((SELECT sum(peers) FROM a WHERE a.info_hash = v.info_hash AND a.sec BETWEEN v.sec AND v.e1), 0) AS p1,
      coalesce((SELECT sum(peers) FROM a WHERE a.info_hash = v.info_hash AND a.sec > v.e1 AND a.sec <= v.e2), 0) AS p2 FROM v)
SELECT request_id, info_hash, e2 + 1 < (SELECT max(floor(epoch(ts)) // 60) FROM events) - 60 AS closed, CAST(CASE WHEN p1 = 0 AND NOT late THEN p2 ELSE p1 END AS BIGINT) AS total_peers,
  CASE WHEN p1 = 0 AND NOT late THEN late2 ELSE late END AS timed_out, p1 = 0 AND NOT late AS retry_attempted FROM s
""")
def refresh_stream(lake: Lake):
    """The last report of every request, open ones included. Minutes stand for seconds, so that a month of events holds
    many overlapping waits."""
    n, asks = F.col("event_id"), F.col("event_type") == "signup"
    rows = events(lake).withColumn("at", F.floor(F.unix_timestamp("ts") / 60)).select(
        F.sha1(F.col("user_id").cast("string")).alias("info_hash"), F.timestamp_seconds("at").alias("ts"), "at",
        F.when(asks, n).alias("request_id"),
        F.when(asks, F.when(n % 4 == 0, F.col("at") + 200).when(n % 4 != 1, F.col("at") + 3)).alias("done_at"),
        F.when(asks & (n % 2 == 0), F.col("at") + 250).alias("retry_done_at"),
        F.when(asks, 0).otherwise(n % 4).alias("peers"),
    )
    reports = run(lake, sp.refresh_stream(rows, "60 seconds", WAIT), "update")
    values = F.struct("total_peers", "timed_out", "retry_attempted", "closed")
    last = reports.groupBy("info_hash", "request_id").agg(F.max_by(values, F.struct("closed", "epoch")).alias("_last"))
    return last.select("info_hash", "request_id", "_last.*")


RECORD = """SELECT event_id, ts, sha1(CAST(user_id % 97 AS VARCHAR)) AS info_hash,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'fetched' ELSE 'observed' END AS result, p_name AS name
FROM events JOIN part ON p_partkey = event_id % 200"""
BANNED = [("ring", 9), ("blue", 9), ("gear", 3)]


@query("s_ingest", over(e=RECORD, attempts="""SELECT info_hash, ts, event_id, name,
  CASE WHEN result = 'fetched' AND (contains(lower(name), 'ring') OR contains(lower(name), 'blue')) THEN 'filtered' ELSE result END AS outcome FROM e""") + STRIKES + """
, a AS (SELECT info_hash, arg_min(name, (ts, event_id)) AS name, min(event_id) FILTER (outcome = 'fetched') AS any_id,
        arg_min(event_id, (ts, event_id)) AS event_id FROM attempts WHERE outcome IN ('fetched', 'filtered') GROUP BY 1)
SELECT s.info_hash, seen_as, CASE WHEN seen_as = 'fetched' THEN a.name END AS name,
       CASE WHEN seen_as = 'fetched' THEN a.event_id % 3 ELSE 0 END AS n_files,
       CASE WHEN seen_as = 'fetched' AND a.event_id % 3 > 0 THEN 'dir/' || a.name END AS first_path, seen_as IS NULL AND first_strike AS struck
FROM s LEFT JOIN a USING (info_hash) WHERE first_strike OR seen_as IS NOT NULL
""")
def ingest(lake: Lake):
    """Fetch results of several micro-batches through the whole chain: seen set, judgement, catalogue, strikes."""
    n = F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "fetched").otherwise("observed")
    rows = event_batches(lake).withColumn("p_partkey", n % 200).join(lake.part.select("p_partkey", "p_name"), "p_partkey")
    files = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.struct(
        (k - 1).alias("file_index"), F.when(k == 1, F.concat(F.lit("dir/"), "p_name")).otherwise(F.lit("z")).alias("path"), F.lit(5).cast("bigint").alias("size_bytes")
    ))
    records = rows.select(
        F.sha1((F.col("user_id") % 97).cast("string")).alias("info_hash"), F.col("ts").alias("at"), "event_id", outcome.alias("outcome"), F.col("p_name").alias("name"),
        F.lit(10).cast("bigint").alias("size_bytes"), F.lit(1).alias("total_peers"), F.slice(files, F.lit(1), (n % 3).cast("int")).alias("files"),
    )
    path = scratch(lake.spark, "ingest")
    store = chain.create_store(lake.spark, f"{path}/store", 8)
    chain.ingest_stream(
        records, store, f"{path}/checkpoint", lambda rows: max_keyword_weight(F.lower("name"), BANNED) >= 9, available_now=True, merge_after=2
    ).awaitTermination()
    now = chain.tables(store)
    paths = chain.catalogstore.rebuild_paths(now["files"], now["prefixes"])
    listed = paths.groupBy("info_hash").agg(F.count(F.lit(1)).alias("n_files"), F.min_by("path", "file_index").alias("first_path"))
    seen = now["seen"].select("info_hash", "seen_as", F.lit(False).alias("struck"))
    struck = now["strikes"].select("info_hash", F.lit(None).cast("string").alias("seen_as"), F.lit(True).alias("struck"))
    known = seen.union(struck).join(now["items"].select("info_hash", "name"), "info_hash", "left").join(listed, "info_hash", "left")
    return known.select("info_hash", "seen_as", "name", F.coalesce("n_files", F.lit(0).cast("bigint")).alias("n_files"), "first_path", "struck")


@query("z7_catalog_store", """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS name, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id)
SELECT sha1(CAST(user_id AS VARCHAR)) AS info_hash, name, event_id % 3 AS n_files FROM l
""")
def catalog_store(lake: Lake):
    """Items with files from several micro-batches; each event is a version of its user's item."""
    n = F.col("event_id")
    files = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.struct(
        k.alias("file_index"), F.concat(F.lit("a/b"), k.cast("string"), F.lit("/f")).alias("path"), F.lit(5).cast("bigint").alias("size_bytes")
    ))
    records = event_batches(lake).select(
        F.sha1(F.col("user_id").cast("string")).alias("info_hash"), F.col("event_type").alias("name"), F.lit(5).cast("bigint").alias("size_bytes"),
        F.lit(1).alias("total_peers"), F.col("ts").alias("added_ts"), n.alias("seq"), F.slice(files, F.lit(1), (n % 3).cast("int")).alias("files"),
    )
    path = scratch(lake.spark, "catalog")
    catalog = CatalogStore.create(lake.spark, f"{path}/store", 8)
    chain.catalog_store_stream(records, catalog, f"{path}/checkpoint", available_now=True, rows=2000).awaitTermination()
    counts = catalog.files().groupBy("info_hash").agg(F.count(F.lit(1)).alias("n_files"))
    return catalog.items().select("info_hash", "name").join(counts, "info_hash", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("bigint")))
