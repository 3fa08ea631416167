"""The ingest chain as one stream: several tables that move on together, batch by batch.

A micro-batch of fetch results is taken against what is known of its keys: rows of seen keys fall out, records are judged,
failures are counted with those of earlier batches. What follows - accepted records to the catalogue, their keys, rejected and
blocked ones to the seen set, first failures to the strikes - is one epoch of one store (``sources.buckets``): all of
it counts or none. A batch that is repeated after a failure finds the state it began with, since epochs are merged
only once the stream has gone past them, and replaces itself.

A batch opens the buckets of its own keys and the few batches that wait to be merged, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentlake.operators.dedup import first_rows, two_strike
from contentlake.session import pinned
from contentlake.settings import DEFAULTS
from contentlake.sources import catalogstore
from contentlake.sources.buckets import Buckets
from contentlake.sources.catalogstore import KEY, CatalogStore, Frames

SEEN = catalogstore.fields(info_hash="string", seen_as="string", at="timestamp")
STRIKES = catalogstore.fields(info_hash="string", at="timestamp", event_id="long")
TABLES = catalogstore.TABLES | {"seen": (SEEN, KEY), "strikes": (STRIKES, KEY)}


def create_store(spark: SparkSession, path: str, buckets: int = 64) -> Buckets:
    return Buckets.create(spark, path, TABLES, buckets)


def combine(base: Frames, delta: Frames) -> Frames:
    """The catalogue merged as ever; a key enters the seen set once, and its strike goes when it does."""
    out = catalogstore.combine({n: base[n] for n in catalogstore.TABLES}, {n: delta[n] for n in catalogstore.TABLES})
    seen = base["seen"].unionByName(delta["seen"].select(SEEN.names)).dropDuplicates([KEY])
    strikes = base["strikes"].unionByName(delta["strikes"].select(STRIKES.names))
    return out | {"seen": seen, "strikes": strikes.join(seen.select(KEY), KEY, "left_anti")}


def known(store: Buckets, name: str, buckets: set[int], epochs: list[int]) -> DataFrame:
    """Rows of a table for the keys of some buckets, waiting batches included."""
    own = store.delta(name, epochs).filter(store.bucket_of(F.col(KEY)).isin(sorted(buckets))) if buckets else store.delta(name, [])
    return store.base(name, buckets).unionByName(own.select(TABLES[name][0].names))


def take_batch(store: Buckets, batch: DataFrame, epoch: int, rejected: Callable[[DataFrame], Column]) -> None:
    """One micro-batch of records(info_hash, at, event_id, outcome, name, size_bytes, total_peers, files)."""
    batch = batch.filter(F.col(KEY).isNotNull())
    buckets = store.touched(batch, KEY)
    epochs = store.waiting(before=epoch)
    seen = known(store, "seen", buckets, epochs)
    fresh = batch.join(seen.select(KEY), KEY, "left_anti")
    judged = F.when((F.col("outcome") == "fetched") & F.coalesce(rejected(batch), F.lit(False)), "filtered").otherwise(F.col("outcome"))
    fresh = fresh.withColumn("outcome", judged)
    earlier = known(store, "strikes", buckets, epochs).join(fresh.select(KEY).distinct(), KEY, "left_semi")
    attempts = fresh.select(KEY, "at", "event_id", "outcome").unionByName(earlier.withColumn("outcome", F.lit("failed")))
    standing = pinned(two_strike(attempts, KEY, "at", "event_id"))  # a row per key of the batch; what follows agrees on it
    accepted = standing.filter("seen_as = 'fetched'").select(KEY)
    done = first_rows(fresh.filter("outcome IN ('fetched', 'filtered')"), KEY, [F.asc("at"), F.asc("event_id")])
    taken = done.join(accepted, KEY, "left_semi")
    seq = F.lit(0).cast("bigint").alias("seq")
    items = taken.select(KEY, "name", "size_bytes", "total_peers", F.col("at").alias("added_ts"), seq)
    files = taken.select(KEY, seq, F.inline("files"))
    struck = standing.filter("first_strike AND seen_as IS NULL").select(KEY)
    failures = first_rows(fresh.filter("outcome = 'failed'"), KEY, [F.asc("at"), F.asc("event_id")])
    new = {
        "seen": standing.filter("seen_as IS NOT NULL").select(KEY, "seen_as", F.col("seen_at").alias("at")),
        "strikes": failures.join(struck, KEY, "left_semi").join(earlier.select(KEY), KEY, "left_anti").select(STRIKES.names),
    }
    store.append(CatalogStore.rows(items, files, epoch) | new, epoch)


def ingest_stream(
    records: DataFrame, store: Buckets, checkpoint: str, rejected: Callable[[DataFrame], Column], available_now: bool = False,
    seconds: int = DEFAULTS.flush_seconds, merge_after: int = 8,
) -> StreamingQuery:
    """records(info_hash, at, event_id, outcome in 'fetched'/'failed'/other, name, size_bytes, total_peers, files: array of
    (file_index, path, size_bytes)) -> the store's tables. ``rejected`` judges a record by its columns.

    A key is seen once it was fetched (accepted or rejected) or failed twice; later rows of it are left out. Batches are merged
    after ``merge_after`` of them.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        if len(store.waiting(before=epoch)) >= merge_after:
            store.merge(combine, before=epoch)
        take_batch(store, batch, epoch, rejected)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"})).start()


def tables(store: Buckets) -> Frames:
    """All tables as they are now."""
    state = store.manifest()
    epochs = store.waiting(state)
    return combine({n: store.base(n, None, state) for n in TABLES}, {n: store.delta(n, epochs) for n in TABLES})


def catalog_store_stream(
    records: DataFrame, catalog: CatalogStore, checkpoint: str, available_now: bool = False,
    rows: int = DEFAULTS.batch_rows, seconds: int = DEFAULTS.flush_seconds,
) -> StreamingQuery:
    """records(info_hash, name, size_bytes, total_peers, added_ts, seq, files) -> the stored catalogue. Every micro-batch is safe
    once written; batches are merged when ``rows`` items wait or the last merge is ``seconds`` ago."""

    def take(batch: DataFrame, epoch: int) -> None:
        catalog.flush(rows, seconds, before=epoch)
        files = batch.select(KEY, "seq", F.inline("files"))
        catalog.write(batch.drop("files"), files, epoch)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"})).start()
