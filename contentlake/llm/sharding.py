"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Documents of one text form a group. Groups that hold a noticeable share of a shard are items of their own, the many small
ones are gathered by hash into a fixed number of cells; both are bounded by parameters, whatever the input. Items are
placed largest first, each where the dot product of its sizes with the shards' residual capacities is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wn
from pyspark.sql import functions as F

from contentlake.llm.common import saved
from contentlake.llm.mixing import word_count


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, words, rows). Sizes are shares of the whole, so every shard has a capacity of
    1 / shards of each. An item that no longer fits in bytes anywhere goes where the most bytes are free."""
    totals = items.sum(axis=0)
    shares = items / np.where(totals > 0, totals, 1)
    residual = np.full((shards, shares.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for k in np.argsort(-shares.max(axis=1), kind="stable"):
        fits = residual[:, 0] >= shares[k, 0]
        if fits.any():
            out[k] = np.argmax(np.where(fits, residual @ shares[k], -np.inf))
        else:
            out[k] = np.argmax(residual[:, 0])
        residual[out[k]] -= shares[k]
    return out


def shard(docs: DataFrame, shards: int = 16, cells: int = 1 << 14, fraction: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs`` (doc_id, text).

    Size is the text's UTF-8 bytes (NULL: none) plus 1, the checksum of a NULL text that of no bytes. The law is ``bytes``: sizes
    of shards are near equal, words and rows about so; grown_shard is NULL. Rows of equal texts share a shard unless
    they fill more than one by themselves, then they are dealt into pieces. Slots number a shard's rows from 0 without gaps.
    A group is an item of its own from 1 / (shards * fraction) of all bytes, words or rows, so there are at most
    3 * shards * fraction of those, and ``cells`` others. Repeated rows and NULL ids are rows like any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("words"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = saved(rows, "rows")
    key = ["hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), (F.sum("words")).alias("words"), F.sum("size").alias("bytes"))
    groups = saved(groups, "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.sum("n").alias("n")).first()
    share = [F.col(c) / float(max(total[c] or 0, 1)) for c in ("bytes", "words", "n")]
    groups = groups.withColumn("share", F.greatest(*share))
    large = F.col("share") >= 1 / (shards * fraction)
    # Pieces of half a shard for what fills more than one.
    pieces = F.when(F.col("share") > 1 / shards, F.ceil(F.col("share") * shards * 2)).otherwise(1).cast("int")
    big = groups.filter(large).withColumn("pieces", pieces).orderBy(*key).collect()
    cell = F.pmod("hash", F.lit(cells)).cast("int")
    small = groups.filter(~large).groupBy(cell.alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.sum("n").alias("n")
    )
    small = small.orderBy("cell").collect()
    items = [(r["bytes"] / r["pieces"], r["words"] / r["pieces"], r["n"] / r["pieces"]) for r in big for _ in range(r["pieces"])]
    items += [(r["bytes"], r["words"], r["n"]) for r in small]
    placed = place(np.array(items, float).reshape(-1, 3), shards).tolist()
    spark = docs.sparkSession
    of_big, at = [], 0
    for r in big:
        of_big.append((r["hash"], r["text_crc32"], r["size"], placed[at : at + r["pieces"]]))
        at += r["pieces"]
    of_small = [(r["cell"], s) for r, s in zip(small, placed[at:], strict=True)]
    big_map = spark.createDataFrame(of_big, "hash long, text_crc32 long, size long, places array<int>")
    small_map = spark.createDataFrame(of_small, "cell int, place int")
    # Both maps are bounded by the parameters above (some 20,000 short rows).
    found = rows.withColumn("cell", cell).join(F.broadcast(big_map), key, "left").join(F.broadcast(small_map), "cell", "left")
    piece = F.element_at("places", (F.pmod("row", F.size("places")) + 1).cast("int"))
    found = found.withColumn("shard", F.when(F.col("places").isNotNull(), piece).otherwise(F.col("place")))
    # Rows of one input partition and shard are numbered together, after those of the partitions before it.
    found = found.withColumn("block", F.shiftright("row", 33))
    counts = found.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Wn.partitionBy("shard").orderBy("block").rowsBetween(Wn.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Wn.partitionBy("shard", "block").orderBy("row"))
    out = found.withColumn("own", own).join(counts, ["shard", "block"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hash",
    )
