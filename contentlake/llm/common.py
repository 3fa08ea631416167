"""Helpers that several operators share: saved steps, bounded sketches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contentlake.session import checkpoint_folder, pinned

U64 = np.uint64


def saved(df: DataFrame, kind: str) -> DataFrame:
    """Write a step as Parquet into the shared checkpoint folder and read it back: what follows never recomputes it."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts(spark: SparkSession, times: int = 1) -> int:
    """Number of hash buckets for packed rows: a multiple of the cluster's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * times


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def batch_of(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def scan(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields dictionaries of columns."""
    target = arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            yield batch_of(columns, target)

    return df.mapInArrow(run, schema)


def each_group(grouped: GroupedData, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """applyInArrow over batches (a group is streamed, never held whole by Spark), yielding dictionaries of columns."""
    target = arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            yield batch_of(columns, target)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped.applyInArrow(run, schema)


def each_run(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """``work`` on the rows of each key (long or int columns), as one Arrow table. Keys share tasks and are sorted there, so
    that many small keys cost no more than a few large ones; a task holds one key at a time."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[a] for c in columns)
                if waiting and key != last:
                    out = work(pa.Table.from_batches(waiting))
                    waiting = []
                    if out:
                        yield out
                last = key
                waiting.append(batch.slice(a, b - a))
        if waiting:
            out = work(pa.Table.from_batches(waiting))
            if out:
                yield out

    def gathered(batches, rows=5000):
        held: list[dict] = []
        count = 0
        for out in run(batches):
            held.append(out)
            count += len(next(iter(out.values())))
            if count >= rows:
                yield {k: [x for o in held for x in o[k]] for k in held[0]}
                held, count = [], 0
        if held:
            yield {k: [x for o in held for x in o[k]] for k in held[0]}

    return scan(ordered, gathered, schema)


class Counters:
    """Counts of hashed keys in 2**bits cells, as a task gathers them: memory is fixed, whatever the input."""

    CELLS = 1 << 18  # cells in a row of the table that the tasks hand on

    def __init__(self, bits: int):
        self.shift = U64(64 - bits)
        self.cells = np.zeros(1 << bits, np.uint16)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append((hashes >> self.shift).astype(np.uint32))
        self.held += len(hashes)
        if self.held > 1 << 21:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            cells, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.cells[cells] = np.minimum(self.cells[cells] + counts, 65535)
            self.waiting, self.held = [], 0

    def rows(self) -> tuple[list[int], list[bytes]]:
        self._count()
        size = min(self.CELLS, len(self.cells))
        found = [(k, self.cells[a : a + size]) for k, a in enumerate(range(0, len(self.cells), size))]
        found = [(k, c) for k, c in found if c.any()]
        return [k for k, _ in found], [squeeze(c.tobytes()) for _, c in found]


def cell_flags(rows: DataFrame, bits: int, flag: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Add up the ``(block int, cells binary)`` rows of all tasks and return one flag per cell. ``flag`` turns summed
    counts into booleans. The driver gets 2**(bits - 3) bytes, whatever the input."""

    def add(batches):
        total, block = np.zeros(1, np.uint32), 0
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, total = k, np.minimum(total + np.frombuffer(unsqueeze(cells), np.uint16), 1 << 30)
        yield {"block": [block], "flags": [np.packbits(flag(total)).tobytes()]}

    size = min(Counters.CELLS, 1 << bits)
    out = np.zeros(1 << bits, bool)
    for row in each_group(rows.groupBy("block"), add, "block int, flags binary").collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.unpackbits(np.frombuffer(row["flags"], np.uint8))
    return out


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour ``m`` of their node ``a``; ``least`` is a saved table."""
    return edges.join(least, "a")


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of an edge: root is the smallest node that links reach.

    Alternating large-star and small-star rounds (the published method for MapReduce): every star is one
    aggregate and one join over the edges, which shrink to stars; each round is checkpointed. The root of a large group
    has an edge for each member, so its least neighbour is found by partial aggregates and saved as a table: the join
    then has two plain shuffles, which Spark splits where a node is hot. Nodes are of any ordered type; NULL ends no edge.
    """
    stars = pinned(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct())
    state = None
    for _ in range(most_rounds):
        both = stars.union(stars.select("b", "a"))
        # Large star: neighbours larger than a node go to the least of the node and its neighbours.
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours go to the least of them.
        down = saved(large.filter("a <> b").distinct(), "star")
        least = saved(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = with_least(down, least).selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b"))
        new = pinned(small.filter("a <> b").distinct())
        stars, before = new, state
        state = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            # Done: every edge leads to its root.
            roots = stars.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            return roots.union(stars.selectExpr("b AS node", "b AS root").distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
