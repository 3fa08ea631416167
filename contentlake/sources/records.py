"""Record blobs: size guard, digest check, bulk decoding, conversion to catalogue rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from contentlake.settings import DEFAULTS

FILE = StructType([StructField("path", StringType()), StructField("size_bytes", LongType())])
RECORD = StructType(
    [
        StructField("name", StringType()),
        StructField("size_bytes", LongType()),
        StructField("files", ArrayType(FILE)),
    ]
)


def limit_size(df: DataFrame, blob: str, max_bytes: int = DEFAULTS.max_record_bytes) -> DataFrame:
    return df.filter(F.octet_length(blob) <= max_bytes)


def digest_ok(blob: Column, key: Column) -> Column:
    """The SHA-1 of the blob equals the key (40 hex digits, any case)."""
    return F.coalesce(F.sha1(blob) == F.lower(key), F.lit(False))


def verify_digest(df: DataFrame, blob: str, key: str) -> DataFrame:
    return df.filter(digest_ok(F.col(blob), F.col(key)))


def digest_counts(df: DataFrame, blob: str, key: str) -> DataFrame:
    ok = digest_ok(F.col(blob), F.col(key))
    return df.agg(F.count(F.when(ok, 1)).alias("verified"), F.count(F.when(~ok, 1)).alias("hash_mismatch"))


LARGEST = (1 << 63) - 1


def _number(digits: bytes) -> int:
    if not re.fullmatch(rb"-?[0-9]{1,19}", digits) or abs(int(digits)) > LARGEST:
        raise ValueError("no 64-bit number")
    return int(digits)


def _value(data: bytes, at: int):
    """The bencoded value at ``at`` and the position after it. Of equal keys the last counts; numbers have 64 bits."""
    kind = data[at : at + 1]
    if kind == b"i":
        end = data.index(b"e", at)
        return _number(data[at + 1 : end]), end + 1
    if kind in (b"l", b"d"):
        items, at = [], at + 1
        while data[at : at + 1] != b"e":
            item, at = _value(data, at)
            items.append(item)
        return (items if kind == b"l" else dict(zip(items[::2], items[1::2]))), at + 1
    colon = data.index(b":", at)
    start = colon + 1
    end = start + _number(data[at:colon])
    if end < start:
        raise ValueError("a string of negative length")
    if end > len(data):
        raise ValueError("string runs past the end")
    return data[start:end], end


def _text(value) -> str | None:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else None


def decode_record(blob: bytes, strict: bool = False) -> dict | None:
    """One info dictionary as a record, or None when it cannot be one.

    ``length`` makes a single file named like the record; else ``files`` gives paths joined with
    ``/``, empty parts left out; with neither, one empty file stands for the record, or ``strict``
    rejects it. A number or sum of sizes beyond 64 bits is no record; bytes after the value are ignored.
    """
    try:
        info, _ = _value(blob, 0)
    except (ValueError, IndexError, RecursionError, TypeError):
        return None
    name = _text(info.get(b"name")) if isinstance(info, dict) else None
    if name is None:
        return None
    length = info.get(b"length")
    if isinstance(length, int) and length >= 0:
        return {"name": name, "size_bytes": length, "files": [{"path": name, "size_bytes": length}]}
    files = []
    for entry in info.get(b"files") or []:
        if not isinstance(entry, dict):
            continue
        path = "/".join(part for part in map(_text, entry.get(b"path") or []) if part)
        size = entry.get(b"length")
        if path:
            files.append({"path": path, "size_bytes": size if isinstance(size, int) else 0})
    if files:
        total = sum(f["size_bytes"] for f in files)
        return {"name": name, "size_bytes": total, "files": files} if abs(total) <= LARGEST else None
    if strict:
        return None
    return {"name": name, "size_bytes": 0, "files": [{"path": name, "size_bytes": 0}]}


def decode_records(df: DataFrame, blob: str, strict: bool = False) -> DataFrame:
    """``df`` with the blob replaced by (name, size_bytes, files); undecodable rows are dropped."""
    other = [f for f in df.schema.fields if f.name != blob]
    schema = StructType(other + RECORD.fields)

    names = [f.name for f in other]
    file_type = pa.list_(pa.struct([("path", pa.string()), ("size_bytes", pa.int64())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [None if b is None else decode_record(b, strict) for b in batch.column(blob).to_pylist()]
            kept = batch.filter(pa.array([r is not None for r in records], pa.bool_()))
            found = [r for r in records if r is not None]
            columns = [kept.column(name) for name in names] + [
                pa.array([r["name"] for r in found], pa.string()),
                pa.array([r["size_bytes"] for r in found], pa.int64()),
                pa.array([r["files"] for r in found], file_type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names + RECORD.names)

    return df.mapInArrow(decode, schema)


def decode_json_records(df: DataFrame, text: str) -> DataFrame:
    """The same shape from JSON text; rows without a name are dropped."""
    parsed = df.withColumn("_r", F.from_json(F.col(text), RECORD)).filter(F.col("_r.name").isNotNull())
    size = F.aggregate(F.col("_r.files"), F.lit(0).cast("bigint"), lambda acc, f: acc + F.coalesce(f["size_bytes"], F.lit(0)))
    other = [c for c in df.columns if c != text]
    return parsed.select(
        *other,
        F.col("_r.name").alias("name"),
        F.coalesce("_r.size_bytes", size).alias("size_bytes"),
        F.col("_r.files").alias("files"),
    )


def read_records(spark, path: str) -> DataFrame:
    """(path, blob): one record per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").alias("blob"))


def to_item_rows(records: DataFrame, peers: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, item_files) from records(info_hash, name, size_bytes, files)."""
    items = records.select(
        "info_hash", "name", "size_bytes", peers.cast("int").alias("total_peers"), now.alias("added_ts")
    )
    exploded = records.select("info_hash", F.posexplode("files").alias("file_index", "_f"))
    files = exploded.select("info_hash", "file_index", F.col("_f.path").alias("path"), F.col("_f.size_bytes").alias("size_bytes"))
    return items, files
