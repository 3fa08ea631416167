"""Small frame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row: a union of a few rows folded by an aggregate, without a join."""
    fields = [field for frame in frames for field in frame.schema.fields]

    def widened(frame: DataFrame) -> DataFrame:
        own = set(frame.columns)
        return frame.select(
            *[F.col(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        )

    rows = reduce(DataFrame.unionAll, map(widened, frames))
    return rows.agg(*[F.first(f.name, ignorenulls=True).alias(f.name) for f in fields])


def join_nullable(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is NULL in many left rows.

    NULL keys match nothing but would all meet in one task; a salt deals them out.
    """
    other = [c for c in left.columns if c != key]
    salt = F.when(F.col(key).isNull(), F.xxhash64(*other)).otherwise(F.lit(0).cast("bigint"))
    known = right.withColumn("_salt", F.lit(0).cast("bigint"))
    return left.withColumn("_salt", salt).join(known, [key, "_salt"], "left").drop("_salt")
