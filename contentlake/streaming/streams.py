"""Streaming sources, native stateful operators and the micro-batch catalogue sink.

All operators work on event time; watermarks and timers bound their state, but for ``admit_new``, whose
seen keys are a table. The keyed operators of ``processors`` need ``ROCKSDB`` as the session's state store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from contentlake.operators.dedup import first_rows
from contentlake.settings import DEFAULTS
from contentlake.sources.buckets import Buckets
from contentlake.sources.sinks import EPOCH, read_catalog, write_catalog_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """A parquet folder or glob as a stream; ``max_files`` per trigger limits the input."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def dedup_stream(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of a key; the key is forgotten ``delay`` after it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def minute_counts_stream(df: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    windowed = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute"), *keys)
    return windowed.agg(F.count(F.lit(1)).alias("n"))


def rolling_hour_stream(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Counts of the 60 minutes that end with each minute.

    Rows are counted per minute first, so only minute counts are multiplied by the 60 hours they
    belong to.
    """
    minutes = minute_counts_stream(df, ts, delay).select(F.window_time("window").alias("_at"), "n")
    hours = minutes.groupBy(F.window("_at", "60 minutes", "1 minute")).agg(F.sum("n").alias("last_hour"))
    return hours.select((F.floor(F.unix_timestamp("window.end") / 60) - 1).alias("minute"), "last_hour")


def minute_number(window: str = "window") -> Column:
    return F.floor(F.unix_timestamp(f"{window}.start") / 60)


def drop_seen_stream(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Stream rows whose key is not in the static seen set."""
    return df.join(seen.select(key), key, "left_anti")


def admit_new(
    df: DataFrame, seen: DataFrame, key: str, order: list[Column], path: str, checkpoint: str, available_now: bool = False,
    buckets: int = 64, merge_after: int = 8,
) -> StreamingQuery:
    """The first row in ``order`` of every key that is neither in ``seen`` nor admitted by an earlier micro-batch.

    Admitted rows go to ``path``/rows, their keys to the store ``path``/seen in ``buckets``. A batch opens the buckets of its own
    keys and the at most ``merge_after`` batches that wait to be merged, however long the stream has run; a repeated
    batch finds the state it began with and replaces itself. Rows with a NULL key are left out.
    """
    schema = StructType([df.schema[key]])
    try:
        store = Buckets.open(df.sparkSession, f"{path}/seen")
    except AnalysisException:  # a new stream: the given keys are the first merged batch
        store = Buckets.create(df.sparkSession, f"{path}/seen", {"seen": (schema, key)}, buckets)
        store.append({"seen": seen.select(key).filter(F.col(key).isNotNull()).distinct()}, 0)
        store.merge(merge_keys)

    def admit(batch: DataFrame, epoch: int) -> None:
        epoch += 1  # 0 are the given keys
        if len(store.waiting(before=epoch)) >= merge_after:
            store.merge(merge_keys, before=epoch)
        batch = batch.filter(F.col(key).isNotNull())
        known = store.base("seen", store.touched(batch, key)).union(store.delta("seen", store.waiting(before=epoch)).select(key))
        new = first_rows(batch, key, order).join(known, key, "left_anti")
        write_catalog_batch(new.select(*batch.columns), f"{path}/rows", epoch)
        own = batch.sparkSession.read.schema(schema).parquet(f"{path}/rows/{EPOCH}={epoch}")
        store.append({"seen": own}, epoch)

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(admit)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_keys(base: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: rows.unionByName(delta[name].select(rows.columns)).distinct() for name, rows in base.items()}


def catalog_sink(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = False, seconds: int = DEFAULTS.flush_seconds
) -> StreamingQuery:
    """Write each micro-batch under its epoch; :func:`read_catalog` gives the upserted rows.

    The time trigger and the source's ``maxFilesPerTrigger`` set the batch size. A batch that is
    repeated after a failure replaces itself.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: write_catalog_batch(batch, path, epoch)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def compact_catalog(spark: SparkSession, path: str, target: str) -> None:
    """The upserted rows as epoch 0 of a new catalogue folder."""
    write_catalog_batch(read_catalog(spark, path), target, 0)


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return what it emitted, with its ``epoch``.

    Results pass through files in ``folder``, never through the driver.
    """
    spark = df.sparkSession
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        running = (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: write_catalog_batch(batch, f"{folder}/out", epoch))
            .start()
        )
        running.awaitTermination()
    finally:
        if previous is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
    return spark.read.schema(StructType([*df.schema.fields, StructField(EPOCH, IntegerType())])).parquet(f"{folder}/out")


def last_update(df: DataFrame, key: str) -> DataFrame:
    """The last emitted row per key of an update-mode stream."""
    columns = [c for c in df.columns if c not in (key, EPOCH)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), EPOCH).alias("_last"))
    return last.select(key, "_last.*")
