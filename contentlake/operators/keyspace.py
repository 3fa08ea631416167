"""Key-space and node analytics over nodes(node_id, queries_sent, responses_received,
last_responded_at, fail_count, ...). ``now`` is always a parameter, in epoch seconds; node times are
epoch seconds in BIGINT, NULL for never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.functions.ids import bucket_index, distance_share, first_byte_distance
from contentlake.operators.ordering import last_known
from contentlake.settings import DEFAULTS


def is_distant(node_id: Column, center: Column | str) -> Column:
    return first_byte_distance(node_id, center) > DEFAULTS.distant_first_byte


def distance_split(nodes: DataFrame, center: str) -> DataFrame:
    """One row: close and distant nodes and their shares."""
    distant = is_distant(F.col("node_id"), center)
    counts = nodes.agg(
        F.count(F.when(~distant, 1)).alias("close_nodes"), F.count(F.when(distant, 1)).alias("distant_nodes")
    )
    total = F.col("close_nodes") + F.col("distant_nodes")

    def share(column: str) -> Column:
        return F.when(total > 0, F.round(F.col(column) * 100.0 / total, 6)).otherwise(0.0)

    return counts.select(
        "close_nodes", "distant_nodes", share("close_nodes").alias("close_percent"),
        share("distant_nodes").alias("distant_percent"),
    )


def eviction_score(center: str, now: int) -> Column:
    """0.6 distance + 0.2 age (full after 300 s) + 0.2 (1 - response rate); never answered counts
    as old, never asked as medium."""
    last, sent = F.col("last_responded_at"), F.col("queries_sent")
    age = F.when(last.isNull(), 1.0).when(F.lit(now) - last > 300, 1.0).otherwise((F.lit(now) - last) / 300.0)
    quality = F.when(sent > 0, 1.0 - F.col("responses_received") / sent).otherwise(0.5)
    return distance_share(F.col("node_id"), center) * 0.6 + age * 0.2 + quality * 0.2


def eviction_candidates(nodes: DataFrame, center: str, now: int, n: int) -> DataFrame:
    scored = nodes.withColumn("score", eviction_score(center, now))
    return scored.orderBy(F.desc("score"), "node_id").limit(n)


def low_quality(nodes: DataFrame, min_rate: float, min_queries: int, n: int | None = None) -> DataFrame:
    rate = F.col("responses_received") / F.col("queries_sent")
    poor = nodes.filter((F.col("queries_sent") >= min_queries) & (F.col("queries_sent") > 0) & (rate < min_rate))
    return poor if n is None else poor.orderBy("node_id").limit(n)


def oldest(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.asc_nulls_first("last_responded_at"), "node_id").limit(n)


def prune_distant(nodes: DataFrame, center: str, share: float, cap: int) -> DataFrame:
    """The oldest ``share`` of the distant nodes, at most ``cap``.

    The size of the cut is one number from a counting pass, so the cut itself is a top-n per task
    and not a rank over all rows in one task.
    """
    if not 0.0 <= share <= 1.0:
        raise ValueError("share must lie between 0 and 1")
    distant = nodes.filter(is_distant(F.col("node_id"), center))
    return oldest(distant, min(int(distant.count() * share), cap))


def sample_candidates(nodes: DataFrame, center: str, now: int) -> DataFrame:
    """Nodes that may be asked for a sample: not dropped, not known incapable, due, and fresh enough
    (60 s when distant, 300 s when close) or never heard from."""
    age = F.lit(now) - F.col("last_responded_at")
    fresh = F.when(is_distant(F.col("node_id"), center), DEFAULTS.distant_fresh_seconds).otherwise(
        DEFAULTS.close_fresh_seconds
    )
    return nodes.filter(
        ~F.col("dropped")
        & (F.col("capability") != "no")
        & (F.col("next_sample_at") <= now)
        & (F.col("last_responded_at").isNull() | (age <= fresh))
    )


def next_sample_time(responses: DataFrame) -> DataFrame:
    """responses(node_id, at, seq, found, total, interval) -> per node the schedule after the last one.

    Nothing found waits the interval plus 300 s; otherwise an interval over 300 s shrinks to 60 s.
    """
    last = F.max(F.struct("at", "seq", "found", "total", "interval"))
    folded = responses.groupBy("node_id").agg(last.alias("last"), F.sum("found").alias("sampled_num"))
    found, interval = F.col("last.found"), F.col("last.interval")
    wait = (
        F.when(found == 0, interval + DEFAULTS.empty_sample_penalty)
        .when(interval > 300, DEFAULTS.sample_interval)
        .otherwise(interval)
    )
    return folded.select(
        "node_id",
        F.col("last.at").alias("last_responded_at"),
        (F.col("last.at") + wait).alias("next_sample_at"),
        found.alias("last_discovered_num"),
        F.col("last.total").alias("total_num"),
        "sampled_num",
    )


def node_stats(events: DataFrame) -> DataFrame:
    """events(node_id, at, kind in 'query'/'response') -> counters and last response per node."""
    answered = F.col("kind") == "response"
    return events.groupBy("node_id").agg(
        F.count(F.when(F.col("kind") == "query", 1)).alias("queries_sent"),
        F.count(F.when(answered, 1)).alias("responses_received"),
        F.max(F.when(answered, F.col("at"))).alias("last_responded_at"),
    )


def capability(events: DataFrame) -> DataFrame:
    """events(node_id, at, seq, kind in 'seen'/'capable'/'incapable') -> last status and sighting.

    A capable answer is a sighting, an incapable one is not.
    """
    is_status = F.col("kind").isin("capable", "incapable")
    return events.groupBy("node_id").agg(
        F.coalesce(F.max(F.when(is_status, F.struct("at", "seq", "kind")))["kind"], F.lit("unknown")).alias("status"),
        F.max(F.when(F.col("kind") != "incapable", F.col("at"))).alias("last_seen"),
    )


def capable_count(folded: DataFrame) -> DataFrame:
    return folded.agg(F.count(F.when(F.col("status") == "capable", 1)).alias("capable"))


def capable_pool(nodes: DataFrame, now: int, cooldown: int = DEFAULTS.cooldown_seconds) -> DataFrame:
    """Capable nodes off cooldown; a node never asked has last_queried 0."""
    ready = F.col("status") == "capable"
    if cooldown > 0:
        ready = ready & (F.lit(now) - F.coalesce("last_queried", F.lit(0)) >= cooldown)
    return nodes.filter(ready)


def sample_capable(nodes: DataFrame, k: int, now: int, cooldown: int = DEFAULTS.cooldown_seconds, seed: int = 0):
    """(sample, nodes with last_queried stamped on the sample). The sample has at most ``k`` rows."""
    sample = sample_k(capable_pool(nodes, now, cooldown), "node_id", k, seed)
    picked = sample.select("node_id", F.lit(now).alias("_now"))
    stamped = nodes.join(picked, "node_id", "left").withColumn("last_queried", F.coalesce("_now", "last_queried"))
    return sample, stamped.drop("_now")


def sample_order(key: str, seed: int) -> list[Column]:
    """A random but repeatable order: the MD5 of seed and key, then the key."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def sample_k(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``k`` rows, repeatable for a seed and safe under task retries: ranked by
    a seeded hash of the key (top-k per task)."""
    return df.orderBy(*sample_order(key, seed)).limit(k)


def sample_k_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    order = Window.partitionBy(group).orderBy(*sample_order(key, seed))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def percent_bucket(key: Column) -> Column:
    """0..99 from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def sample_percent(df: DataFrame, key: str, percent: int = DEFAULTS.submit_percent) -> DataFrame:
    """A repeatable ``percent`` of the keys, decided row by row."""
    return df.filter(percent_bucket(F.col(key)) < percent)


def fail_counts(events: DataFrame, order: list[str]) -> DataFrame:
    """events(node_id, kind in 'seen'/'failed') -> failures since the last sighting per node.

    Failures of a node never sighted have nothing to count on. A plain max and a counting join: no
    node's events are ever sorted in one task.
    """
    at = F.struct(*order)
    seen = events.groupBy("node_id").agg(F.max(F.when(F.col("kind") == "seen", at)).alias("_seen"))
    seen = seen.filter(F.col("_seen").isNotNull())
    rows = events.filter("kind = 'failed'").join(seen, "node_id")
    failed = (
        rows.filter(at > F.col("_seen"))
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("fail_count"))
    )
    return seen.select("node_id").join(failed, "node_id", "left").withColumn(
        "fail_count", F.coalesce("fail_count", F.lit(0))
    )


def evict_failed(events: DataFrame, order: list[str], limit: int = DEFAULTS.max_failures) -> DataFrame:
    """Nodes with their failures since the last sighting and whether that removes them."""
    return fail_counts(events, order).withColumn("evicted", F.col("fail_count") >= limit)


def running_last_seen(events: DataFrame, order: list[str]) -> DataFrame:
    """Each event with the last sighting of its node up to then."""
    seen = F.when(F.col("kind") == "seen", F.col(order[0]))
    return last_known(events, ["node_id"], order, seen, "last_seen")


def bounded_buckets(nodes: DataFrame, center: str, cap: int = DEFAULTS.bucket_capacity) -> DataFrame:
    """Per distance bucket the ``cap`` best nodes: working before failed, then last seen, then id.

    Half of all ids share the top bucket; the rank filter keeps at most ``cap`` rows per bucket and
    task before anything moves.
    """
    failed = (F.col("fail_count") >= DEFAULTS.max_failures).cast("int")
    order = Window.partitionBy("bucket").orderBy(failed, F.desc_nulls_last("last_responded_at"), "node_id")
    placed = nodes.withColumn("bucket", bucket_index(F.col("node_id"), center))
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def admit_to_bucket(buckets: DataFrame, newcomers: DataFrame, now: int, cap: int = DEFAULTS.bucket_capacity,
                    min_age: int = DEFAULTS.min_evict_age) -> DataFrame:
    """buckets and newcomers(bucket, node_id, last_seen, fail_count): which newcomers fit now.

    A newcomer takes a free slot, else the slot of a failed node, else that of a node unseen for
    ``min_age`` seconds, else it is rejected.
    """
    known = newcomers.join(buckets.select("node_id"), "node_id", "left_anti")
    room = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("held"),
        F.count(
            F.when((F.col("fail_count") >= DEFAULTS.max_failures) | (F.lit(now) - F.col("last_seen") >= min_age), 1)
        ).alias("evictable"),
    )
    order = Window.partitionBy("bucket").orderBy(F.desc("last_seen"), "node_id")
    ranked = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    slots = F.greatest(F.lit(cap) - F.coalesce("held", F.lit(0)), F.lit(0)) + F.coalesce("evictable", F.lit(0))
    return ranked.join(room, "bucket", "left").filter(F.col("rank") <= slots).drop("held", "evictable")


def merge_nodes(base: DataFrame, new: DataFrame, touch: bool = True) -> DataFrame:
    """(node_id, last_seen, fail_count): a sighting refreshes a known node and clears its failures
    when ``touch``; otherwise only unknown nodes are added."""
    old = base.select("node_id", F.col("last_seen").alias("_old"), F.col("fail_count").alias("_fails"))
    seen = new.groupBy("node_id").agg(F.max("last_seen").alias("_new"))
    both = old.join(seen, "node_id", "full")
    known, refreshed = F.col("_old").isNotNull(), F.col("_new").isNotNull() & F.lit(touch)
    return both.select(
        "node_id",
        F.when(known & ~refreshed, F.col("_old")).otherwise(F.greatest("_old", "_new")).alias("last_seen"),
        F.when(known & ~refreshed, F.col("_fails")).otherwise(0).alias("fail_count"),
    )
