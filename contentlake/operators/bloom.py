"""Membership filter as a table of 64-bit words.

All bits of a key lie in one block of 32,768, at places that follow from its MD5 digest, so any other engine finds the same
bits. Building groups bits by (block, word) with a bitwise OR that combines in every task first: a full or hot filter sends
each word once per task, however many keys set it. Probing brings the distinct keys to their words, a few numbers each; rows
with a NULL key stay where they are. Size grows with the capacity, so nothing is broadcast by force: Catalyst picks the
joins from the size statistics.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.operators.frames import join_nullable

BLOCK_BITS = 32768
WORD_BITS = 64


@dataclass(frozen=True)
class BloomShape:
    capacity: int
    error_rate: float

    @property
    def bits(self) -> int:
        return max(1, math.ceil(-self.capacity * math.log(self.error_rate) / math.log(2) ** 2))

    @property
    def hashes(self) -> int:
        return max(1, math.ceil(math.log(2) * self.bits / self.capacity))

    @property
    def blocks(self) -> int:
        return math.ceil(self.bits / BLOCK_BITS)

    def marks(self, digest: Column) -> Column:
        """(block, word, mask) for each bit of a key, from its digest of 32 hex digits.

        The first 15 digits choose the block; the places in it step by the last 8 from the 8 before, with a cubic term
        that parts keys whose steps agree.
        """

        def number(at: int, digits: int) -> Column:
            return F.conv(F.substring(digest, at, digits), 16, 10).cast("bigint")

        block, first, step = F.pmod(number(1, 15), F.lit(self.blocks)), number(17, 8), number(25, 8)
        places = [F.pmod(first + i * step + (i**3 - i) // 6, F.lit(BLOCK_BITS)) for i in range(self.hashes)]
        one = F.lit(1).cast("bigint")
        marks = [
            F.struct(
                block.alias("block"), F.floor(place / WORD_BITS).cast("int").alias("word"),
                F.call_function("shiftleft", one, F.pmod(place, F.lit(WORD_BITS)).cast("int")).alias("mask"),
            )
            for place in places
        ]
        return F.array(*marks)


def digest_of(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


@dataclass(frozen=True)
class BloomTable:
    """Immutable filter: ``words`` is a frame (block, word, bits)."""

    shape: BloomShape
    words: DataFrame

    @classmethod
    def build(cls, df: DataFrame, key: str, capacity: int, error_rate: float = 0.001) -> BloomTable:
        shape = BloomShape(capacity, error_rate)
        marks = df.filter(F.col(key).isNotNull()).select(F.inline(shape.marks(digest_of(key))))
        return cls(shape, marks.groupBy("block", "word").agg(F.bit_or("mask").alias("bits")))

    def union(self, other: BloomTable) -> BloomTable:
        if self.shape != other.shape:
            raise ValueError("filters of different shape cannot be merged")
        both = self.words.unionByName(other.words)
        return replace(self, words=both.groupBy("block", "word").agg(F.bit_or("bits").alias("bits")))

    def add(self, df: DataFrame, key: str) -> BloomTable:
        return self.union(BloomTable.build(df, key, self.shape.capacity, self.shape.error_rate))

    def probe(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``maybe_seen``: false is certain, true may be wrong at about the error rate."""
        asked = df.select(digest_of(key).alias("_digest")).filter("_digest IS NOT NULL").distinct()
        marks = asked.select("_digest", F.inline(self.shape.marks(F.col("_digest"))))
        met = marks.join(self.words, ["block", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        known = met.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == self.shape.hashes)
        known = known.select("_digest", F.lit(True).alias("maybe_seen"))
        joined = join_nullable(df.withColumn("_digest", digest_of(key)), known, "_digest")
        return joined.select(*df.columns, F.coalesce("maybe_seen", F.lit(False)).alias("maybe_seen"))

    def stats(self) -> DataFrame:
        return self.words.agg(
            F.lit(self.shape.capacity).alias("capacity"),
            F.lit(self.shape.error_rate).alias("error_rate"),
            F.lit(self.shape.blocks * BLOCK_BITS).alias("bits"),
            F.lit(self.shape.hashes).alias("hashes"),
            F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("bits_set"),
        )

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        note = self.words.sparkSession.createDataFrame([(json.dumps(asdict(self.shape)),)], "shape string")
        note.write.mode("overwrite").text(f"{path}/shape")

    @classmethod
    def load(cls, spark, path: str, capacity: int, error_rate: float) -> BloomTable | None:
        """The saved filter, or None when it was made for another capacity or error rate."""
        wanted = BloomShape(capacity, error_rate)
        saved = BloomShape(**json.loads(spark.read.text(f"{path}/shape").first()[0]))
        return cls(wanted, spark.read.parquet(f"{path}/words")) if saved == wanted else None

    @classmethod
    def empty(cls, spark, capacity: int, error_rate: float = 0.001) -> BloomTable:
        return cls(BloomShape(capacity, error_rate), spark.createDataFrame([], "block bigint, word int, bits bigint"))
