"""Peer lists, retries, failure classes and refresh requests.

Observations are rows (key, ip, port, at); times are epoch seconds in BIGINT and ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.functions.net import is_public_peer, is_routable
from contentlake.operators.frames import side_by_side
from contentlake.settings import DEFAULTS


def peer_lists(
    observations: DataFrame, now: int, ttl: int, per_key: int, max_keys: int, key: str = "key"
) -> DataFrame:
    """(key, ip, port, at, rank): unexpired peers, newest sighting per address, the newest
    ``per_key`` of each key, for the ``max_keys`` keys updated last."""
    fresh = observations.filter(F.lit(now) - F.col("at") <= ttl)
    latest = fresh.groupBy(key, "ip", "port").agg(F.max("at").alias("at"))
    updated = latest.groupBy(key).agg(F.max("at").alias("_updated"))
    kept = updated.orderBy(F.desc("_updated"), key).limit(max_keys)
    order = Window.partitionBy(key).orderBy(F.desc("at"), "ip", "port")
    ranked = latest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_key)
    return ranked.join(kept.select(key), key, "left_semi")


def peer_counts(observations: DataFrame, key: str = "key", cap: int = DEFAULTS.peers_per_key) -> DataFrame:
    """Distinct routable peers per key, at most ``cap``."""
    peers = observations.filter(is_routable(F.col("ip"), F.col("port"))).select(key, "ip", "port").distinct()
    return peers.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("peers"))


def expire(df: DataFrame, now: int, ttl: int, at: str = "at") -> DataFrame:
    return df.filter(F.lit(now) - F.col(at) <= ttl)


def expire_counts(df: DataFrame, now: int, ttl: int, at: str = "at") -> DataFrame:
    stale = F.lit(now) - F.col(at) > ttl
    return df.agg(F.count(F.when(~stale, 1)).alias("kept"), F.count(F.when(stale, 1)).alias("expired"))


def store_stats(peers: DataFrame, lookups: DataFrame, key: str = "key") -> DataFrame:
    """One row: keys, peers, average per key, lookups by outcome and hit rate.

    ``lookups(hit boolean)``.
    """
    per_key = peers.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    held = per_key.agg(F.count(F.lit(1)).alias("total_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_peers"))
    asked = lookups.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
    both = side_by_side(held, asked)
    keys, tried = F.col("total_keys"), F.col("hits") + F.col("misses")
    return both.withColumn(
        "avg_peers", F.when(keys > 0, F.round(F.col("total_peers") / keys, 6)).otherwise(0.0)
    ).withColumn("hit_rate", F.when(tried > 0, F.round(F.col("hits") * 100.0 / tried, 6)).otherwise(0.0))


def ready_keys(observations: DataFrame, key: str = "key", minimum: int = DEFAULTS.ready_peers,
               cap: int = DEFAULTS.peers_per_key) -> DataFrame:
    """Keys with at least ``minimum`` public peers in one answer; the work unit holds at most ``cap``.

    Every reported address counts, repeats included.
    """
    public = observations.filter(is_public_peer(F.col("ip"), F.col("port")))
    counted = public.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return counted.select(key, F.least("_n", F.lit(cap)).alias("peers"))


def should_retry(attempts: Column, peers: Column, in_progress: Column, max_attempts: int = DEFAULTS.max_attempts,
                 min_peers: int = DEFAULTS.ready_peers) -> Column:
    return (attempts < max_attempts) & (peers < min_peers) & ~in_progress


def due_retries(entries: DataFrame, now: int, n: int = DEFAULTS.retry_tick) -> tuple[DataFrame, DataFrame]:
    """(taken, entries after the tick): up to ``n`` due entries, earliest first; a taken entry loses
    its due time and is in progress."""
    due = entries.filter(F.col("due_at").isNotNull() & (F.col("due_at") > 0) & (F.col("due_at") <= now))
    taken = due.orderBy("due_at", "key").limit(n)
    mark = taken.select("key", F.lit(True).alias("_taken"))
    after = entries.join(mark, "key", "left")
    after = after.withColumn("due_at", F.when(F.col("_taken"), F.lit(None)).otherwise(F.col("due_at")))
    after = after.withColumn("in_progress", F.coalesce(F.col("_taken"), F.lit(False)) | F.col("in_progress"))
    return taken, after.drop("_taken")


def retry_due_at(last_attempt: Column, delay_ms: int) -> Column:
    """Delays count in whole seconds, so 300 ms is due at once."""
    return last_attempt + delay_ms // 1000


def retry_stats(outcomes: DataFrame) -> DataFrame:
    """outcomes(key, attempts, peers) -> one row of success by attempt, percentages and efficiency.

    ``attempts`` counts the first try; a key that ends without peers failed whatever its attempts.
    """
    ok, tries = F.col("peers") > 0, F.col("attempts")
    counts = outcomes.agg(
        F.count(F.when(ok & (tries == 1), 1)).alias("success_first"),
        F.count(F.when(ok & (tries == 2), 1)).alias("success_second"),
        F.count(F.when(ok & (tries >= 3), 1)).alias("success_third"),
        F.count(F.when(~ok, 1)).alias("failed_all"),
        F.coalesce(F.sum(F.greatest(tries - 1, F.lit(0))), F.lit(0)).alias("retries"),
    )
    done = F.col("success_first") + F.col("success_second") + F.col("success_third") + F.col("failed_all")

    def percent(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part * 100.0 / whole, 6)).otherwise(0.0)

    return counts.select(
        "*",
        percent(F.col("success_first"), done).alias("first_percent"),
        percent(F.col("success_second"), done).alias("second_percent"),
        percent(F.col("success_third"), done).alias("third_percent"),
        percent(F.col("failed_all"), done).alias("failed_percent"),
        percent(F.col("success_second") + F.col("success_third"), F.col("retries")).alias("retry_efficiency"),
    )


def cleanup_old(entries: DataFrame, now: int, max_age: int, only_finished: bool = False) -> DataFrame:
    """Entries that stay. Requests (``only_finished``) go only when complete or timed out."""
    stale = F.lit(now) - F.col("created_at") > max_age
    if only_finished:
        stale = stale & (F.col("complete") | F.col("timed_out"))
    return entries.filter(~stale)


# Fixed values: (class, texts looked for) in the order they are tried.
FAILURE_RULES = (
    ("timeout", ("timeout",)),
    ("connect", ("connect",)),
    ("handshake", ("handshake", "info_hash mismatch")),
    ("no_support", ("no extension support", "ut_metadata")),
    ("rejected", ("rejected",)),
    ("hash_mismatch", ("hash",)),
)
# Connection states in order of progress.
STATES = (
    "connecting", "handshaking", "extended_handshake", "requesting_metadata", "receiving_metadata", "complete", "failed",
)


def classify_failure(reason: Column) -> Column:
    """The first rule that finds one of its texts; NULL when none does."""
    out = F
    for name, texts in FAILURE_RULES:
        hit = F.lit(False)
        for text in texts:
            hit = hit | F.contains(reason, F.lit(text))
        out = out.when(hit, name)
    return out


def attempt_rollup(connections: DataFrame, key: str = "info_hash") -> DataFrame:
    """connections(key, close_reason, state 0..6, at) -> failures per class, reach and times per key."""
    kind = classify_failure(F.col("close_reason"))
    rows = connections.withColumn("_class", kind)
    per_class = [F.count(F.when(F.col("_class") == name, 1)).alias(name) for name, _ in FAILURE_RULES]
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("tried"),
        *per_class,
        F.max("state").alias("furthest_state"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


def first_success(connections: DataFrame, key: str = "info_hash", order: tuple[str, str] = ("at", "event_id")) -> DataFrame:
    """Per key the first fetched connection and how many others were closed as already fetched."""
    at, tie = order
    first = F.min(F.when(F.col("outcome") == "fetched", F.struct(at, tie)))
    folded = connections.groupBy(key).agg(first.alias("_first"), (F.count(F.lit(1)) - 1).alias("closed_others"))
    won = folded.filter(F.col("_first").isNotNull())
    return won.select(key, F.col("_first")[tie].alias(tie), F.col("_first")[at].alias(at), "closed_others")


def refresh_report(requests: DataFrame, answers: DataFrame, seconds: int = DEFAULTS.request_seconds) -> DataFrame:
    """requests(request_id, info_hash, at, done_at, retry_done_at) and answers(info_hash, at, peers).

    A request sums the peers reported within its wait. The wait ends when the search is done or
    after ``seconds`` (timed out, the partial sum counts). Zero peers without a timeout are asked
    once more, with a second wait that starts where the first ended.
    """
    first_end = F.least(F.coalesce("done_at", F.col("at") + seconds), F.col("at") + seconds)
    waits = requests.withColumn("_end", first_end).withColumn(
        "_late", F.col("done_at").isNull() | (F.col("done_at") > F.col("at") + seconds)
    )
    second_end = F.least(F.coalesce("retry_done_at", F.col("_end") + seconds), F.col("_end") + seconds)
    waits = waits.withColumn("_end2", second_end).withColumn(
        "_late2", F.col("retry_done_at").isNull() | (F.col("retry_done_at") > F.col("_end") + seconds)
    )
    # answers are summed per key and second first, so a hot key meets its requests as few rows
    sums = answers.groupBy("info_hash", "at").agg(F.sum("peers").alias("peers")).withColumnRenamed("at", "_at")
    # a wait covers a few slots of ``seconds``; the slot makes the interval join an equi-join
    slot_of = lambda column: F.floor(column / seconds)
    spans = waits.select(
        "request_id", "info_hash", "at", "_end", "_end2",
        F.explode(F.sequence(slot_of(F.col("at")), slot_of(F.col("_end2")))).alias("_slot"),
    )
    inside = spans.join(sums.withColumn("_slot", slot_of(F.col("_at"))), ["info_hash", "_slot"])
    got = inside.groupBy("request_id").agg(
        F.sum(F.when((F.col("_at") >= F.col("at")) & (F.col("_at") <= F.col("_end")), F.col("peers"))).alias("_p1"),
        F.sum(F.when((F.col("_at") > F.col("_end")) & (F.col("_at") <= F.col("_end2")), F.col("peers"))).alias("_p2"),
    )
    both = waits.join(got, "request_id", "left")
    first_sum, second_sum = F.coalesce("_p1", F.lit(0)), F.coalesce("_p2", F.lit(0))
    retried = (first_sum == 0) & ~F.col("_late")
    peers = F.when(retried, second_sum).otherwise(first_sum)
    timed_out = F.when(retried, F.col("_late2")).otherwise(F.col("_late"))
    note = (
        F.when(timed_out & (peers == 0) & retried, "warning: both timed out without peers")
        .when(timed_out & (peers == 0), "warning: timed out without peers")
        .when(timed_out, "warning: timed out with a partial count")
        .when(retried & (peers > 0), "info: found on retry")
    )
    return both.select(
        "request_id", "info_hash", peers.alias("total_peers"), timed_out.alias("timed_out"),
        retried.alias("retry_attempted"), note.alias("note"),
    )
