"""Batch sinks of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.operators.dedup import latest_versions

EPOCH = "epoch"


def write_catalog_batch(df: DataFrame, path: str, epoch: int) -> None:
    """Write one batch under its epoch. A repeated epoch replaces itself, so retries are harmless."""
    df.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")


def read_catalog(spark: SparkSession, path: str, key: str = "info_hash") -> DataFrame:
    """The current rows: per key the one added last, later epochs first among equals."""
    rows = spark.read.parquet(path)
    return latest_versions(rows, key, "added_ts", EPOCH).drop(EPOCH)


def write_clustered(df: DataFrame, path: str, *columns: str) -> None:
    """Write rows in global order of ``columns``, so that file and row-group statistics prune reads
    by them (item_id for files, info_hash for look-ups, added_ts for the latest items)."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def to_json_report(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON object in column ``name``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
