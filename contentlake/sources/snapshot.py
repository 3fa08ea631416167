"""Snapshots with an integrity manifest.

Data goes to a new version folder; a manifest line that names it is appended last and is the commit
point, so a lost job leaves the previous snapshot valid. A save drops the data of the one before
the previous. The digest is order-insensitive: a sum over per-row SHA-256 prefixes, computed by the
cluster.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.session import delete_folder

MAGIC = "contentlake-snapshot"
VERSION = 1


class SnapshotError(ValueError):
    """The snapshot is missing parts or was changed."""


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a frame, independent of row order and partitioning."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(row.alias("h"))
    sums = [
        F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{i}")
        for i in range(4)
    ]
    result = parts.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    return result["rows"], "-".join(f"{int(result[f's{i}']):x}" for i in range(4))


def _last_notes(spark: SparkSession, path: str, n: int = 1) -> list[dict]:
    """The last ``n`` manifest entries, newest first, however many saves there were."""
    try:
        lines = spark.read.text(f"{path}/manifest")
    except AnalysisException:
        return []
    seq = F.get_json_object("value", "$.seq").cast("bigint")
    last = lines.select("value", seq.alias("seq")).orderBy(F.desc_nulls_first("seq")).limit(n).collect()
    if any(r["seq"] is None for r in last):
        raise SnapshotError("unreadable manifest")
    return [json.loads(r["value"]) for r in last]


def save_snapshot(df: DataFrame, path: str) -> bool:
    """Write the frame and commit it; an empty frame is skipped (False)."""
    spark = df.sparkSession
    data = f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    rows, check = digest(spark.read.parquet(f"{path}/{data}"))
    if rows == 0:
        return False
    earlier = _last_notes(spark, path, 2)
    seq = earlier[0]["seq"] + 1 if earlier else 1
    note = {"magic": MAGIC, "version": VERSION, "seq": seq, "data": data, "rows": rows, "digest": check}
    line = spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1)
    line.write.mode("append").text(f"{path}/manifest")
    for old in earlier[1:]:  # the one before stays for readers that have begun
        delete_folder(spark, f"{path}/{old['data']}")
    return True


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last committed frame, after checking its row count and digest."""
    entries = _last_notes(spark, path)
    if not entries:
        raise SnapshotError("no manifest")
    note = entries[0]
    if note.get("magic") != MAGIC or note.get("version") != VERSION:
        raise SnapshotError("not a snapshot of this version")
    try:
        df = spark.read.parquet(f"{path}/{note['data']}")
    except AnalysisException as error:
        raise SnapshotError("data folder is missing") from error
    rows, check = digest(df)
    if rows != note["rows"]:
        raise SnapshotError(f"{rows} rows, {note['rows']} expected")
    if check != note["digest"]:
        raise SnapshotError("digest mismatch")
    return df
