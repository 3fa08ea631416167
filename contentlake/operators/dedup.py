"""Seen-set joins, de-duplication, upsert and failure blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from contentlake.functions.net import is_routable
from contentlake.operators.bloom import BloomTable
from contentlake.operators.frames import side_by_side


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, lowest in ``order``; losers are dropped before the shuffle (rank = 1)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def drop_seen(df: DataFrame, seen: DataFrame, key: str = "info_hash") -> DataFrame:
    """Rows whose key is not in the seen set. The set side is reduced to its key."""
    return df.join(seen.select(key), key, "left_anti")


def existing(df: DataFrame, keys: DataFrame, key: str = "info_hash") -> DataFrame:
    """Asked keys with an ``exists`` flag."""
    known = df.select(key).join(keys.select(key), key, "left_semi").distinct()
    return keys.join(known.withColumn("exists", F.lit(True)), key, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def drop_confirmed(
    df: DataFrame, bloom: BloomTable, store: DataFrame, key: str = "info_hash", priority: Column | None = None
) -> DataFrame:
    """Drop rows that the Bloom table reports and the store confirms; priority rows bypass both.

    Only the distinct reported keys reach the confirming join.
    """
    rows = df.withColumn("_priority", F.coalesce(priority, F.lit(False)) if priority is not None else F.lit(False))
    asked = rows.filter(~F.col("_priority")).select(key).distinct()
    reported = bloom.probe(asked, key).filter("maybe_seen").select(key)
    confirmed = reported.join(store.select(key), key, "left_semi")
    kept = rows.join(confirmed.withColumn("_dup", F.lit(True)), key, "left")
    return kept.filter(F.col("_priority") | F.col("_dup").isNull()).drop("_priority", "_dup")


def dedup_with_stats(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Per key the first sighting, the number of arrivals and of duplicates among them."""
    first = F.min(F.struct(ts, tie))
    return df.groupBy(key).agg(
        first[ts].alias("first_seen"),
        first[tie].alias(tie),
        F.count(F.lit(1)).alias("attempts"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
    )


def dedup_totals(df: DataFrame, key: str) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("attempts"),
        F.count(F.lit(1)).alias("accepted"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def latest_versions(items: DataFrame, key: str = "info_hash", added: str = "added_ts", seq: str = "seq") -> DataFrame:
    """Last write wins per key."""
    return first_rows(items, key, [F.desc(added), F.desc(seq)])


def upsert_items(base: DataFrame, batch: DataFrame, key: str = "info_hash") -> DataFrame:
    """``base`` with every key of ``batch`` replaced by its last row there.

    Base rows are never ranked: the (small) batch is reduced to one row per key and only its keys
    are taken out of the base, so a large base is scanned once.
    """
    new = latest_versions(batch, key)
    return base.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_files(
    base_files: DataFrame, batch_files: DataFrame, key: str = "item_id", winners: DataFrame | None = None, version: str = "seq"
) -> DataFrame:
    """Files of replaced items go, the new ones come.

    ``winners``: the batch's items, one (key, version) each as :func:`latest_versions` leaves them. Then only files of that
    version come, and an item whose new version has no files keeps none.
    """
    replaced = (batch_files if winners is None else winners).select(key).distinct()
    new = batch_files
    if winners is not None:
        new = batch_files.join(winners.select(key, version), [key, version], "left_semi").select(*base_files.columns)
    return base_files.join(replaced, key, "left_anti").unionByName(new)


def insert_new(base: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Insert-or-ignore: the first batch row in ``order`` of each key unknown to the base."""
    return base.unionByName(first_rows(batch, key, order).join(base.select(key), key, "left_anti"))


def batch_outcomes(batch: DataFrame, key: str = "info_hash") -> DataFrame:
    """One row: rows written and failed (no key of 40 hex digits, or no name), keys added to seen."""
    ok = F.coalesce(F.regexp_like(F.col(key), F.lit(r"^[0-9a-f]{40}\z")) & F.col("name").isNotNull(), F.lit(False))
    flagged = batch.select(key, ok.alias("ok"))
    per_key = flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("ok"), 1)).alias("good")
    )
    return per_key.agg(
        F.sum("rows").alias("rows"),
        F.sum("good").alias("written"),
        F.sum(F.col("rows") - F.col("good")).alias("failed"),
        F.count(F.when(F.col("good") > 0, 1)).alias("added_to_seen"),
    )


def observe_batch(batch: DataFrame, name: str = "batch", key: str = "info_hash") -> tuple[DataFrame, Observation]:
    """(frame, Observation): the outcome counts of a batch as a by-product of writing it."""
    watch = Observation(name)
    ok = F.regexp_like(F.col(key), F.lit(r"^[0-9a-f]{40}\z")) & F.col("name").isNotNull()
    counted = batch.observe(
        watch, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.coalesce(ok, F.lit(False)), 1)).alias("written")
    )
    return counted, watch


def catalog_totals(items: DataFrame, files: DataFrame) -> DataFrame:
    item_side = items.agg(F.count(F.lit(1)).alias("items"))
    file_side = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_bytes"))
    return side_by_side(item_side, file_side)


def two_strike(attempts: DataFrame, key: str = "info_hash", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Per key the strikes and whether it entered the seen set, and why.

    A key that was fetched or filtered is seen from then on; a first failure allows a retry, the
    second blocks. Failures after a key is seen do not count. Only the first two failures of a
    key pass the shuffle, however often it fails.
    """
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    done = attempts.groupBy(key).agg(
        F.min(F.when(F.col("outcome").isin("fetched", "filtered"), F.struct(at.alias("at"), "outcome"))).alias("done")
    )
    order = Window.partitionBy(key).orderBy(ts, tie)
    failures = attempts.filter("outcome = 'failed'").withColumn("_rank", F.row_number().over(order))
    strikes = (
        failures.filter("_rank <= 2")
        .groupBy(key)
        .agg(F.min(F.when(F.col("_rank") == 1, at)).alias("f1"), F.min(F.when(F.col("_rank") == 2, at)).alias("f2"))
    )
    joined = done.join(strikes, key, "left")

    def counts(f: str) -> Column:
        return F.col(f).isNotNull() & (F.col("done").isNull() | (F.col(f) < F.col("done")["at"]))

    joined = joined.withColumn("first_strike", counts("f1")).withColumn("second_strike", counts("f2"))
    seen_at = F.when(F.col("second_strike"), F.col("f2")["t"]).otherwise(F.col("done")["at"]["t"])
    return joined.select(
        key,
        "first_strike",
        "second_strike",
        F.when(F.col("second_strike"), "blocked").otherwise(F.col("done")["outcome"]).alias("seen_as"),
        seen_at.alias("seen_at"),
    )


def strike_totals(strikes: DataFrame) -> DataFrame:
    return strikes.agg(
        F.count(F.when(F.col("first_strike"), 1)).alias("first_strikes"),
        F.count(F.when(F.col("second_strike"), 1)).alias("second_strikes"),
        F.count("seen_as").alias("seen_keys"),
    )


def fill_from(base: DataFrame, extra: DataFrame, max_new: int, key: str, order: list[Column]) -> DataFrame:
    """``base`` and up to ``max_new`` rows of ``extra`` whose key is new, in ``order``."""
    fresh = first_rows(extra, key, order).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.orderBy(*order).limit(max_new))


def fifo_cache(df: DataFrame, key: str, ts: str, cap: int, ip: Column | None = None, port: Column | None = None) -> DataFrame:
    """The ``cap`` keys first seen most recently; a repeated key keeps its first slot."""
    rows = df.filter(is_routable(ip, port)) if ip is not None and port is not None else df
    first = rows.groupBy(key).agg(F.min(ts).alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), key).limit(cap)
