"""Operational time series: counts, rates, smoothing, hysteresis, partition health, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.functions.text import format_uptime
from contentlake.operators.frames import side_by_side
from contentlake.operators.ordering import SLOT, last_known, run_length, smoothed
from contentlake.operators.peers import classify_failure
from contentlake.settings import DEFAULTS


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole in percent, 0 when the whole is 0."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60)


# --- counts -----------------------------------------------------------------------------------


def minute_counts(df: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, minute_of(F.col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def hourly_count(minutes: DataFrame, now_minute: int) -> DataFrame:
    """Rows of ``now_minute`` and the 59 minutes before it."""
    recent = F.col("minute").between(now_minute - 59, now_minute)
    return minutes.agg(F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("last_hour"))


def rolling_hour(minutes: DataFrame) -> DataFrame:
    """Per minute with data the count of the hour that ends with it.

    Every minute is added to the 60 hours it belongs to and summed by hour, which spreads over all
    tasks; a window over all minutes would run in one.
    """
    ends = minutes.select("n", F.explode(F.sequence("minute", F.col("minute") + 59)).alias("minute"))
    sums = ends.groupBy("minute").agg(F.sum("n").alias("last_hour"))
    return minutes.join(sums, "minute").select("minute", "n", "last_hour")


# --- rates ------------------------------------------------------------------------------------


def interval_counts(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, at, n): cumulative counts at the end of every interval with data.

    Rows collapse to one per key and interval before any ordering, so the series length depends on
    the time covered, not on the number of events of a hot key.
    """
    slot = F.floor(F.unix_timestamp(F.col(ts)) / seconds)
    per_slot = df.groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return per_slot.select(key, ((F.col("slot") + 1) * seconds).alias("at"), F.sum("_n").over(so_far).alias("n"))


def interval_rate(counters: DataFrame, key: str, at: str = "at", n: str = "n") -> DataFrame:
    """Counter difference ``dn`` over ``dt`` seconds between neighbouring readings and their ``rate``,
    0 without elapsed time. The first reading of a key has none (NULL).

    One row per key and check: the window is as long as the time covered, not as the event count.
    """
    order = Window.partitionBy(key).orderBy(at)
    spans = counters.withColumn("dn", F.col(n) - F.lag(n).over(order)).withColumn("dt", F.col(at) - F.lag(at).over(order))
    rate = F.when(F.col("dt") > 0, F.col("dn").cast("double") / F.col("dt")).when(F.col("dt").isNotNull(), 0.0)
    return spans.withColumn("rate", rate)


def ema(series: DataFrame, key: str, order: list[str], x: str, alpha: float = DEFAULTS.ema_alpha, width: int = SLOT) -> DataFrame:
    """``series`` with ``ema``: the first value seeds, then alpha x + (1 - alpha) previous. Keys and values are not NULL."""
    return smoothed(series, key, order, F.col(x), alpha, "ema", width)


def low_rate(
    rates: DataFrame, key: str, minimum: float, min_age: int, grace: int,
    alpha: float = DEFAULTS.ema_alpha, queue: str | None = None,
) -> DataFrame:
    """:func:`interval_rate` readings -> smoothed series with ``low`` and ``shut_down``.

    A reading is low when its average is under ``minimum``, the key is at least ``min_age`` seconds
    old and its queue (if given) is empty. It leads to a shut-down when the average is still under
    the minimum after one more smoothing step, taken at the first reading after the grace period on
    the rate since the reading before the low one. Every reading is judged by itself.
    """
    born = rates.groupBy(key).agg(F.min("at").alias("_born"))
    smoothed = ema(rates.filter(F.col("rate").isNotNull()), key, ["at"], "rate", alpha)
    empty = F.col(queue) <= 0 if queue else F.lit(True)
    aged = smoothed.join(born, key).withColumn("age", F.col("at") - F.col("_born"))
    low = (F.col("ema") < minimum) & (F.col("age") >= min_age) & empty
    # Newest first, so that the frame only ever grows: the first reading after the grace period is the last one in it.
    later = Window.partitionBy(key).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -grace)
    after = F.struct("n", "at", empty.alias("empty"))
    checked = aged.withColumn("low", low).withColumn("_after", F.last(after).over(later))
    counted = F.col("_after.n") - (F.col("n") - F.col("dn"))
    elapsed = F.col("_after.at") - (F.col("at") - F.col("dt"))
    again = alpha * counted / elapsed + (1.0 - alpha) * F.col("ema")
    sustained = F.col("low") & (again < minimum) & F.col("_after.empty")
    return checked.select(
        *rates.columns, "ema", "age", "low",
        F.when(F.col("low"), again).alias("ema_after_grace"),
        F.coalesce(sustained, F.lit(False)).alias("shut_down"),
    )


# --- switches and runs ------------------------------------------------------------------------


def hysteresis(df: DataFrame, key: str, order: list[str], value: str, high: float, low: float, width: int = SLOT) -> DataFrame:
    """``on``: set when value >= high, cleared when value < low, else kept; starts off."""
    decision = F.when(F.col(value) >= high, 1).when(F.col(value) < low, 0)
    known = last_known(df, [key], order, decision, "on", width)
    return known.withColumn("on", F.coalesce("on", F.lit(0)))


def low_streak(df: DataFrame, key: str, order: list[str], low: Column, width: int = SLOT) -> DataFrame:
    """``streak``: consecutive low rows of the key up to each row, 0 on a good one."""
    return run_length(df, [key], order, low, "streak", width)


# --- partitions -------------------------------------------------------------------------------


def partition_rates(workers: DataFrame, n: int) -> DataFrame:
    """workers(partition_index, rate) -> average rate and worker count for every partition 0..n-1."""
    spark = workers.sparkSession
    rates = workers.groupBy("partition_index").agg(F.avg("rate").alias("_avg"), F.count(F.lit(1)).alias("_n"))
    every = spark.range(n).select(F.col("id").cast("int").alias("partition_index"))
    return every.join(rates, "partition_index", "left").select(
        "partition_index",
        F.coalesce("_avg", F.lit(0.0)).alias("avg_rate"),
        F.coalesce("_n", F.lit(0)).alias("workers"),
    )


def choose_partition(
    workers: DataFrame, partitions: DataFrame, min_rate: float, dead_after: int, capacity: int
) -> DataFrame:
    """Where each worker of a snapshot should run next.

    workers(worker_id, partition_index, home, rate); partitions(partition_index, avg_rate, workers,
    streak) with one row per partition, so its size is the partition count. A worker under
    ``min_rate`` adds one to its partition's streak, any other clears it. A partition whose streak
    reaches ``dead_after`` is left: for home when away, else for the partition with the best rate
    (lowest index on ties) that is neither dead nor full. The two best targets are enough for all
    workers, since only the own partition is excluded.
    """
    streaks = partitions.select("partition_index", "streak")
    candidates = partitions.filter((F.col("streak") < dead_after) & (F.col("workers") < capacity))
    best = candidates.select(
        F.struct((-F.col("avg_rate")).alias("r"), F.col("partition_index").alias("p")).alias("c")
    ).orderBy("c").limit(2)
    top = best.agg(F.array_sort(F.collect_list("c")).alias("_best"))  # one row of at most two
    rows = workers.join(streaks, "partition_index", "left").withColumn("_best", top.scalar())
    was_low = F.col("rate") < min_rate
    streak = F.when(was_low, F.coalesce("streak", F.lit(0)) + 1).otherwise(0)
    away = F.col("partition_index") != F.col("home")
    target = F.element_at(
        F.filter(F.transform("_best", lambda c: c["p"]), lambda p: p != F.col("partition_index")), 1
    )
    has_target = F.exists("_best", lambda c: c["p"] != F.col("partition_index"))
    dead = F.col("new_streak") >= dead_after
    decided = rows.withColumn("new_streak", streak)
    return decided.select(
        "worker_id",
        "partition_index",
        "home",
        "new_streak",
        dead.alias("dead"),
        F.when(~dead, F.col("partition_index"))
        .when(away, F.col("home"))
        .when(has_target, target)
        .otherwise(F.col("partition_index"))
        .alias("next_partition"),
        (dead & away).alias("reset_home_streak"),
    )


# --- reports ----------------------------------------------------------------------------------


def fetch_stats(attempts: DataFrame) -> DataFrame:
    """attempts(outcome, close_reason) -> one funnel row with rates."""
    kind = classify_failure(F.col("close_reason"))
    rows = attempts.select("outcome", kind.alias("_class"))

    def outcome(*names: str) -> Column:
        return F.count(F.when(F.col("outcome").isin(*names), 1))

    def failure(name: str) -> Column:
        return F.count(F.when(F.col("_class") == name, 1))

    counts = rows.agg(
        outcome("fetched", "filtered", "failed").alias("total_attempts"),
        F.count(F.lit(1)).alias("connections_initiated"),
        failure("connect").alias("connections_failed"),
        failure("timeout").alias("connections_timeout"),
        failure("handshake").alias("handshake_failed"),
        failure("no_support").alias("no_metadata_support"),
        failure("rejected").alias("metadata_rejected"),
        failure("hash_mismatch").alias("hash_mismatch"),
        outcome("fetched").alias("fetched"),
        outcome("filtered").alias("filtered"),
    )
    return counts.select(
        "*",
        percent(F.col("fetched"), F.col("total_attempts")).alias("success_rate_percent"),
        percent(F.col("filtered"), F.col("total_attempts")).alias("filter_rate_percent"),
        percent(F.col("connections_timeout"), F.col("connections_initiated")).alias("timeout_rate_percent"),
    )


def rates(attempts: DataFrame, key: str) -> DataFrame:
    """Success, filter and timeout rates per group."""
    rows = attempts.select(key, "outcome", classify_failure(F.col("close_reason")).alias("_class"))
    tried = F.count(F.when(F.col("outcome") != "observed", 1))
    counts = rows.groupBy(key).agg(
        tried.alias("attempts"),
        F.count(F.lit(1)).alias("initiated"),
        F.count(F.when(F.col("outcome") == "fetched", 1)).alias("_ok"),
        F.count(F.when(F.col("outcome") == "filtered", 1)).alias("_filtered"),
        F.count(F.when(F.col("_class") == "timeout", 1)).alias("_timeout"),
    )
    return counts.select(
        key,
        "attempts",
        percent(F.col("_ok"), F.col("attempts")).alias("success_rate"),
        percent(F.col("_filtered"), F.col("attempts")).alias("filter_rate"),
        percent(F.col("_timeout"), F.col("initiated")).alias("timeout_rate"),
    )


def cumulative(done: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """Totals over finished and live workers."""
    both = done.select(*columns).unionByName(live.select(*columns))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def group_report(attempts: DataFrame, queues: DataFrame, key: str, capacity: int, pause_at: int, resume_below: int) -> DataFrame:
    """Per group its counts, rates and queue; queues(key, queue_size, paused)."""
    counts = attempts.groupBy(key).agg(
        F.count(F.when(F.col("outcome") == "fetched", 1)).alias("fetched"),
        F.count(F.when(F.col("outcome") == "filtered", 1)).alias("filtered"),
        F.count(F.when(F.col("outcome") == "failed", 1)).alias("failed"),
    )
    limits = F.lit(capacity).alias("queue_capacity"), F.lit(pause_at).alias("pause_threshold"), F.lit(resume_below).alias("resume_threshold")
    return counts.join(queues, key, "left").select(
        key, "fetched", "filtered", "failed", F.coalesce("queue_size", F.lit(0)).alias("queue_size"), *limits,
        F.coalesce("paused", F.lit(False)).alias("paused"),
    )


def as_list(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """A bounded table (groups, partitions) as one row with an array of its rows, in ``order``."""
    entry = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.agg(F.array_sort(F.collect_list(entry)).alias(name))


def hour_section(events: DataFrame, now: int, ts: str = "ts") -> DataFrame:
    """(last_hour): rows of the minute of ``now`` and the 59 before it; older rows are not counted at all."""
    recent = events.filter(F.col(ts) >= F.timestamp_seconds(F.lit((now // 60 - 59) * 60)))
    return hourly_count(minute_counts(recent, ts), now // 60)


def cache_section(cached: DataFrame, capacity: int, submit_percent: int = DEFAULTS.submit_percent) -> DataFrame:
    return cached.agg(F.count(F.lit(1)).alias("cached_nodes")).select(
        "cached_nodes", F.lit(capacity).alias("capacity"), F.lit(submit_percent).alias("submit_percent")
    )


def aggregate_section(attempts: DataFrame) -> DataFrame:
    """Totals over all groups, with the share of attempts that were fetched."""
    counts = attempts.agg(
        F.count(F.when(F.col("outcome") == "fetched", 1)).alias("total_fetched"),
        F.count(F.when(F.col("outcome").isin("fetched", "filtered", "failed"), 1)).alias("total_attempts"),
    )
    return counts.withColumn("success_rate_percent", percent(F.col("total_fetched"), F.col("total_attempts")))


def stats_report(
    sections: dict[str, DataFrame], version: str, now: int, started: int, lists: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One JSON document: an object per section (a one-row frame) and an array per list (see :func:`as_list`)."""
    parts = [frame.select(F.struct(*frame.columns).alias(name)) for name, frame in sections.items()]
    parts += [frame.select(frame.columns[0]) for frame in (lists or {}).values()]
    head = [
        F.lit(version).alias("version"),
        F.lit(now).alias("timestamp"),
        format_uptime(F.lit(now - started)).alias("uptime"),
    ]
    return side_by_side(*parts).select(F.to_json(F.struct(*head, *sections, *(lists or {}))).alias("json"))


def health(nodes: Column, seconds_since_action: Column) -> Column:
    """critical under 10, warning under 50 (act when the last action is over 600 s ago), else ok."""
    act = seconds_since_action > DEFAULTS.action_gap_seconds
    status = F.when(nodes < DEFAULTS.critical_nodes, "critical").when(nodes < DEFAULTS.warning_nodes, "warning").otherwise("ok")
    due = (nodes < DEFAULTS.critical_nodes) | ((nodes < DEFAULTS.warning_nodes) & act)
    return F.struct(status.alias("status"), due.alias("action_due"))


def utilisation(used: Column, capacity: Column) -> Column:
    return percent(used, capacity)
