"""Key-space and node queries K1-K22. The centre is the middle of partition 5 of 16."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentlake.functions import ids
from contentlake.operators import keyspace as k
from contentlake.operators.closest import closest
from contentlake.plans.registry import over, query
from contentlake.sources.tables import Lake

CENTER = "58" + "00" + "80" * 18
NOW = 915_148_800  # 1999-01-01, inside the order dates


def limb_sql(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT"


def xor_sql(a: str, b: str) -> str:
    return " || ".join(f"printf('%08x', xor({limb_sql(a, i)}, {limb_sql(b, i)}))" for i in range(5))


def byte_sql(a: str, b: str) -> str:
    return f"xor(('0x' || substr({a}, 1, 2))::BIGINT, ('0x' || substr({b}, 1, 2))::BIGINT)"


def bucket_sql(a: str, b: str) -> str:
    cases = " ".join(
        f"WHEN xor({limb_sql(a, i)}, {limb_sql(b, i)}) > 0 THEN {127 - 32 * i} + length(ltrim(bin(xor({limb_sql(a, i)}, {limb_sql(b, i)})), '0'))"
        for i in range(5)
    )
    return f"CASE {cases} ELSE 0 END"


C = f"'{CENTER}'"
# nodes with times in epoch seconds, as the operators take them
TIMED = """SELECT node_id, queries_sent, responses_received, CAST(epoch(last_responded_at) AS BIGINT) AS last_responded_at, fail_count FROM nodes"""


def timed_nodes(lake: Lake):
    return lake.nodes.withColumn("last_responded_at", F.unix_timestamp("last_responded_at"))


@query("k1_xor_distance", over("nodes") + f"SELECT node_id, {xor_sql('node_id', C)} AS distance FROM nodes")
def xor_distance(lake: Lake):
    return lake.nodes.select("node_id", ids.xor_distance(F.col("node_id"), CENTER).alias("distance"))


@query("k1_xor_limbs", over("nodes") + f"SELECT node_id, xor({limb_sql('node_id', 0)}, {limb_sql(C, 0)}) AS high, xor({limb_sql('node_id', 4)}, {limb_sql(C, 4)}) AS low FROM nodes")
def xor_limbs(lake: Lake):
    limbs = ids.xor_limbs(F.col("node_id"), CENTER)
    return lake.nodes.select("node_id", limbs[0].alias("high"), limbs[4].alias("low"))


CLOSEST = over("nodes", "items") + f"""
, n AS (SELECT node_id, {', '.join(f"{limb_sql('node_id', i)} AS n{i}" for i in range(5))} FROM nodes WHERE fail_count < 3),
t AS (SELECT DISTINCT info_hash AS target, {', '.join(f"{limb_sql('info_hash', i)} AS t{i}" for i in range(5))} FROM items),
d AS (SELECT target, node_id, xor(n0, t0) AS d0, xor(n1, t1) AS d1 FROM n, t),
r AS (SELECT target, unnest(min({{'d0': d0, 'd1': d1, 'node_id': node_id}}, 8)) AS m FROM d GROUP BY target)
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY m.d0, m.d1) AS INT) AS rank, m.node_id AS node_id FROM r
"""


@query("k2_closest", CLOSEST)
def closest_nodes(lake: Lake):
    """The 8 nearest live nodes of every item."""
    targets = lake.items.select(F.col("info_hash").alias("target"))
    return closest(lake.nodes.filter("fail_count < 3"), targets, 8).select("target", "rank", "node_id")


@query("k2_closest_small_cells", CLOSEST)
def closest_small_cells(lake: Lake):
    """The same with cells far smaller than k, so that most targets need several."""
    targets = lake.items.select(F.col("info_hash").alias("target"))
    near = closest(lake.nodes.filter("fail_count < 3"), targets, 8, leaf=3)
    return near.select("target", "rank", "node_id")


@query("k3_bucket_index", over("nodes") + f"SELECT node_id, CAST({bucket_sql('node_id', C)} AS INT) AS bucket FROM nodes")
def bucket_index(lake: Lake):
    return lake.nodes.select("node_id", ids.bucket_index(F.col("node_id"), CENTER).alias("bucket"))


def partition_sql(h: str, n: int) -> str:
    if n & (n - 1) == 0:
        return f"CAST({limb_sql(h, 0)} // {2**32 // n} AS INT)"
    return f"CAST(('0x' || substr({h}, 1, 2))::BIGINT * {n} // 256 AS INT)"


COUNTS = (1, 7, 10, 16, 32, 256, 1024)


@query("k4_partition_of", over("nodes") + "SELECT node_id, " + ", ".join(f"{partition_sql('node_id', n)} AS p{n}" for n in COUNTS) + " FROM nodes")
def partition_of(lake: Lake):
    return lake.nodes.select("node_id", *[ids.partition_of(F.col("node_id"), n).alias(f"p{n}") for n in COUNTS])


@query("k5_partition_center", over("nodes") + f"""
SELECT DISTINCT {partition_sql('node_id', 32)} AS p32, printf('%02x', {partition_sql('node_id', 32)}::BIGINT * 8 + 4) || '00' || repeat('80', 18) AS c32,
  {partition_sql('node_id', 10)} AS p10, printf('%02x', CAST(ceil({partition_sql('node_id', 10)} * 25.6) AS BIGINT)) || repeat('80', 19) AS c10 FROM nodes
""")
def partition_center(lake: Lake):
    node = F.col("node_id")
    p32, p10 = ids.partition_of(node, 32), ids.partition_of(node, 10)
    return lake.nodes.select(
        p32.alias("p32"), ids.partition_center(p32, 32).alias("c32"), p10.alias("p10"), ids.partition_center(p10, 10).alias("c10")
    ).distinct()


@query("k7_in_partition", over("nodes") + f"""
SELECT node_id, {partition_sql('node_id', 16)} = fail_count AS inside, true AS center_inside FROM nodes
""")
def in_partition(lake: Lake):
    node = F.col("node_id")
    own = ids.partition_of(node, 10)
    return lake.nodes.select(
        "node_id", ids.in_partition(node, F.col("fail_count"), 16).alias("inside"),
        ids.in_partition(ids.partition_center(own, 10), own, 10).alias("center_inside"),
    )


@query("k8_distance_split", over("nodes") + f"""
, b AS (SELECT {byte_sql('node_id', C)} > 128 AS far FROM nodes)
SELECT count(CASE WHEN NOT far THEN 1 END) AS close_nodes, count(CASE WHEN far THEN 1 END) AS distant_nodes,
  round(count(CASE WHEN NOT far THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS close_percent, round(count(CASE WHEN far THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS distant_percent FROM b
""")
def distance_split(lake: Lake):
    return k.distance_split(lake.nodes, CENTER)


@query("k9_eviction", over("nodes", timed=TIMED) + f"""
, s AS (SELECT node_id, (xor({limb_sql('node_id', 0)}, {limb_sql(C, 0)})::DOUBLE * 4294967296.0 + xor({limb_sql('node_id', 1)}, {limb_sql(C, 1)})::DOUBLE) / 18446744073709551615.0::DOUBLE * 0.6::DOUBLE
  + CASE WHEN last_responded_at IS NULL OR {NOW} - last_responded_at > 300 THEN 1.0::DOUBLE ELSE ({NOW} - last_responded_at) / 300.0::DOUBLE END * 0.2::DOUBLE
  + CASE WHEN queries_sent > 0 THEN 1.0::DOUBLE - responses_received::DOUBLE / queries_sent ELSE 0.5::DOUBLE END * 0.2::DOUBLE AS score FROM timed)
SELECT node_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, node_id LIMIT 50
""")
def eviction(lake: Lake):
    return k.eviction_candidates(timed_nodes(lake), CENTER, NOW, 50).select("node_id", F.round("score", 6).alias("score"))


@query("k10_low_quality", over("nodes") + """
SELECT node_id, queries_sent, responses_received FROM nodes WHERE queries_sent >= 5 AND responses_received::DOUBLE / queries_sent < 0.3
""")
def low_quality(lake: Lake):
    return k.low_quality(lake.nodes, 0.3, 5).select("node_id", "queries_sent", "responses_received")


@query("k11_oldest", over("nodes", timed=TIMED) + """
SELECT node_id, last_responded_at FROM timed ORDER BY last_responded_at ASC NULLS FIRST, node_id LIMIT 60
""")
def oldest(lake: Lake):
    return k.oldest(timed_nodes(lake), 60).select("node_id", "last_responded_at")


@query("k12_prune_distant", over("nodes", timed=TIMED) + f"""
, far AS (SELECT *, row_number() OVER (ORDER BY last_responded_at ASC NULLS FIRST, node_id) AS r, count(*) OVER () AS n FROM timed WHERE {byte_sql('node_id', C)} > 128)
SELECT node_id, last_responded_at FROM far WHERE r <= floor(n * 0.5::DOUBLE) AND r <= 400
""")
def prune_distant(lake: Lake):
    return k.prune_distant(timed_nodes(lake), CENTER, 0.5, 400).select("node_id", "last_responded_at")


# nodes with the state the sampling rules look at
SAMPLED = f"""SELECT node_id, fail_count = 3 AS dropped, CASE queries_sent % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END AS capability,
  {NOW} + responses_received * 10 - 40 AS next_sample_at,
  CASE WHEN queries_sent % 5 = 0 THEN NULL ELSE {NOW} - queries_sent * 15 END AS last_responded_at FROM nodes"""


@query("k13_sample_candidates", over("nodes", sampled=SAMPLED) + f"""
SELECT node_id FROM sampled WHERE NOT dropped AND capability <> 'no' AND next_sample_at <= {NOW}
AND (last_responded_at IS NULL OR {NOW} - last_responded_at <= CASE WHEN {byte_sql('node_id', C)} > 128 THEN 60 ELSE 300 END)
""")
def sample_candidates(lake: Lake):
    nodes, sent = lake.nodes, F.col("queries_sent")
    state = nodes.select(
        "node_id", (F.col("fail_count") == 3).alias("dropped"),
        F.when(sent % 3 == 0, "no").when(sent % 3 == 1, "yes").otherwise("unknown").alias("capability"),
        (NOW + F.col("responses_received") * 10 - 40).alias("next_sample_at"),
        F.when(sent % 5 != 0, NOW - sent * 15).alias("last_responded_at"),
    )
    return k.sample_candidates(state, CENTER, NOW).select("node_id")


# answers of nodes, one per event
RESPONSES = """SELECT sha1(CAST(user_id AS STRING)) AS node_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id AS seq,
  CASE event_type WHEN 'error' THEN 0 ELSE event_id % 21 END AS found, event_id % 1000 AS total, event_id % 13 * 60 AS interval_s FROM events"""


@query("k14_next_sample", over(r=RESPONSES) + """
, last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY sec DESC, seq DESC) = 1),
s AS (SELECT node_id, CAST(sum(found) AS BIGINT) AS sampled_num FROM r GROUP BY node_id)
SELECT node_id, sec AS last_responded_at, sec + CASE WHEN found = 0 THEN interval_s + 300 WHEN interval_s > 300 THEN 60 ELSE interval_s END AS next_sample_at,
       found AS last_discovered_num, total AS total_num, sampled_num FROM last JOIN s USING (node_id)
""")
def next_sample(lake: Lake):
    found = F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 21)
    responses = lake.events.select(
        F.sha1(F.col("user_id").cast("string")).alias("node_id"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"),
        found.alias("found"), (F.col("event_id") % 1000).alias("total"), (F.col("event_id") % 13 * 60).alias("interval"),
    )
    return k.next_sample_time(responses)


# node events: clicks are queries, purchases responses, errors failures, views sightings
KINDS = """SELECT sha1(CAST(user_id AS STRING)) AS node_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id AS seq, event_type, value FROM events"""


def node_events(lake: Lake):
    return lake.events.select(
        F.sha1(F.col("user_id").cast("string")).alias("node_id"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"), "event_type", "value"
    )


def kind(**names: str):
    out = F
    for event_type, name in names.items():
        out = out.when(F.col("event_type") == event_type, name)
    return out.alias("kind")


@query("k15_node_stats", over(e=KINDS) + """
SELECT node_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS queries_sent, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS responses_received,
       max(CASE WHEN event_type = 'purchase' THEN sec END) AS last_responded_at FROM e GROUP BY node_id
""")
def node_stats(lake: Lake):
    return k.node_stats(node_events(lake).select("node_id", "at", kind(click="query", purchase="response")))


STATUS = """, c AS (SELECT node_id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'capable' ELSE 'incapable' END, (sec, seq)) FILTER (event_type IN ('purchase', 'error')), 'unknown') AS status,
  max(CASE WHEN event_type <> 'error' THEN sec END) AS last_seen FROM e GROUP BY node_id)
"""


@query("k16_capability", over(e=KINDS) + STATUS + "SELECT * FROM c")
def capability(lake: Lake):
    events = node_events(lake).select("node_id", "at", "seq", kind(purchase="capable", error="incapable", view="seen", click="seen", signup="seen"))
    return k.capability(events)


@query("k16_capable_count", over(e=KINDS) + STATUS + "SELECT count(CASE WHEN status = 'capable' THEN 1 END) AS capable FROM c")
def capable_count(lake: Lake):
    return k.capable_count(capability(lake))


POOL = f"""SELECT node_id, CASE WHEN queries_sent % 2 = 0 THEN 'capable' ELSE 'incapable' END AS status, {NOW} - responses_received AS last_queried FROM nodes"""


def pool(lake: Lake):
    status = F.when(F.col("queries_sent") % 2 == 0, "capable").otherwise("incapable")
    return lake.nodes.select("node_id", status.alias("status"), (NOW - F.col("responses_received")).alias("last_queried"))


@query("k17_capable_pool", over("nodes", pool=POOL) + f"SELECT node_id FROM pool WHERE status = 'capable' AND {NOW} - last_queried >= 3")
def capable_pool(lake: Lake):
    return k.capable_pool(pool(lake), NOW).select("node_id")


@query("k17_sample_capable", over("nodes", pool=POOL) + f"""
, picked AS (SELECT node_id AS id FROM pool WHERE status = 'capable' AND {NOW} - last_queried >= 3 ORDER BY md5('3:' || node_id), node_id LIMIT 10)
SELECT * REPLACE (CASE WHEN node_id IN (SELECT id FROM picked) THEN {NOW} ELSE last_queried END AS last_queried) FROM pool
""")
def sample_capable(lake: Lake):
    _, stamped = k.sample_capable(pool(lake), 10, NOW, seed=3)
    return stamped


@query("k18_sample_k", over("nodes") + "SELECT node_id FROM nodes ORDER BY md5('11:' || node_id), node_id LIMIT 64")
def sample_k(lake: Lake):
    return k.sample_k(lake.nodes, "node_id", 64, seed=11).select("node_id")


@query("k18_sample_k_per_group", """
SELECT event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('11:' || event_id), event_id) <= 20
""")
def sample_k_per_group(lake: Lake):
    return k.sample_k_per_group(lake.events, "event_type", "event_id", 20, seed=11).select("event_type", "event_id")


@query("k19_sample_percent", over("items") + """
SELECT item_id, info_hash FROM items WHERE ('0x' || substr(md5(info_hash), 1, 8))::BIGINT % 100 < 17
""")
def sample_percent(lake: Lake):
    return k.sample_percent(lake.items, "info_hash").select("item_id", "info_hash")


@query("k20_evict_failed", over(e=KINDS) + """
, s AS (SELECT node_id, max((sec, seq)) AS seen FROM e WHERE event_type = 'view' GROUP BY node_id)
SELECT s.node_id, count(f.seq) AS fail_count, count(f.seq) >= 3 AS evicted
FROM s LEFT JOIN e f ON f.node_id = s.node_id AND f.event_type = 'error' AND (f.sec, f.seq) > s.seen GROUP BY s.node_id
""")
def evict_failed(lake: Lake):
    return k.evict_failed(node_events(lake).select("node_id", "at", "seq", kind(view="seen", error="failed")), ["at", "seq"])


@query("k20_running_last_seen", over(e=KINDS) + """
SELECT node_id, seq, last_value(CASE WHEN event_type = 'view' THEN sec END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY sec, seq) AS last_seen FROM e
""")
def running_last_seen(lake: Lake):
    events = node_events(lake).select("node_id", "at", "seq", kind(view="seen", error="failed"))
    return k.running_last_seen(events, ["at", "seq"]).select("node_id", "seq", "last_seen")


@query("k21_bounded_buckets", over("nodes", timed=TIMED) + f"""
, b AS (SELECT node_id, CAST({bucket_sql('node_id', C)} AS INT) AS bucket, fail_count, last_responded_at FROM timed),
r AS (SELECT node_id, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY fail_count >= 3, last_responded_at DESC NULLS LAST, node_id) AS INT) AS rank FROM b)
SELECT * FROM r WHERE rank <= 100
""")
def bounded_buckets(lake: Lake):
    return k.bounded_buckets(timed_nodes(lake), CENTER).select("node_id", "bucket", "rank")


@query("k21_admission", over("nodes", "items", timed=TIMED) + f"""
, b AS (SELECT CAST({bucket_sql('node_id', C)} AS INT) AS bucket, node_id, coalesce(last_responded_at, 0) AS last_seen, fail_count FROM timed),
held AS (SELECT bucket, count(*) AS held, count(CASE WHEN fail_count >= 3 OR {NOW} - last_seen >= 60 THEN 1 END) AS evictable FROM b GROUP BY bucket),
n AS (SELECT CAST({bucket_sql('info_hash', C)} AS INT) AS bucket, info_hash AS node_id, item_id AS last_seen FROM items WHERE info_hash NOT IN (SELECT node_id FROM nodes)),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY last_seen DESC, node_id) AS rank FROM n)
SELECT node_id, bucket FROM r LEFT JOIN held USING (bucket) WHERE rank <= 100 AND rank <= greatest(100 - coalesce(held, 0), 0) + coalesce(evictable, 0)
""")
def admission(lake: Lake):
    bucket = ids.bucket_index(F.col("node_id"), CENTER).alias("bucket")
    held = timed_nodes(lake).select(bucket, "node_id", F.coalesce("last_responded_at", F.lit(0)).alias("last_seen"), "fail_count")
    new = lake.items.select(F.col("info_hash").alias("node_id"), F.col("item_id").alias("last_seen")).withColumn("bucket", bucket)
    return k.admit_to_bucket(held, new, NOW).select("node_id", "bucket")


SEEN = "SELECT node_id, coalesce(last_responded_at, 0) AS last_seen, fail_count FROM timed"
FRESH = "SELECT sha1(CAST(user_id * 3 AS STRING)) AS node_id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS sec FROM events GROUP BY 1"


def seen_and_fresh(lake: Lake):
    base = timed_nodes(lake).select("node_id", F.coalesce("last_responded_at", F.lit(0)).alias("last_seen"), "fail_count")
    new = lake.events.select(F.sha1((F.col("user_id") * 3).cast("string")).alias("node_id"), F.unix_timestamp("ts").alias("last_seen"))
    return base, new


@query("k22_touch_nodes", over("nodes", timed=TIMED, base=SEEN, fresh=FRESH) + """
SELECT node_id, CASE WHEN f.sec IS NULL THEN last_seen ELSE greatest(coalesce(last_seen, f.sec), f.sec) END AS last_seen, CASE WHEN f.sec IS NULL THEN fail_count ELSE 0 END AS fail_count
FROM base FULL JOIN fresh f USING (node_id)
""")
def touch_nodes(lake: Lake):
    return k.merge_nodes(*seen_and_fresh(lake), touch=True)


@query("k22_insert_if_new", over("nodes", timed=TIMED, base=SEEN, fresh=FRESH) + """
SELECT node_id, coalesce(last_seen, f.sec) AS last_seen, coalesce(fail_count, 0) AS fail_count FROM base FULL JOIN fresh f USING (node_id)
""")
def insert_if_new(lake: Lake):
    return k.merge_nodes(*seen_and_fresh(lake), touch=False)
