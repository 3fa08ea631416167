"""Keyed tables in buckets, with batches beside them that are merged in from time to time.

A batch of rows of one or several tables is written under its epoch and counts once the epoch is committed, for all tables
at once; writing an epoch again replaces it. Merging rewrites the buckets that the batches touch, each as a new version, and
then names the versions that count in one new manifest file: readers see the state before or after, and a lost job
leaves the state before. What merged batches and older versions leave behind goes with the next merge, so a reader may
finish on the state it began with, and neither folders nor manifests pile up. One writer at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from contentlake.session import delete_folder, together
from contentlake.sources.ranged import EPOCH, commit, committed


class Manifest(NamedTuple):
    """The state that counts: its number, the last epoch merged into it, when, and (table, bucket) -> version."""

    number: int
    through: int
    at: float
    versions: dict[tuple[str, int], int]


class Buckets:
    """``tables``: name -> (schema of its rows, key column)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[StructType, str]], buckets: int):
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, tuple[StructType, str]], buckets: int = 64) -> Buckets:
        """An empty store; what its readers must know is kept with it."""
        note = {"buckets": buckets, "tables": {n: [s.jsonValue(), k] for n, (s, k) in tables.items()}}
        spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.text(f"{path}/note")
        return cls(spark, path, tables, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Buckets:
        note = json.loads(spark.read.text(f"{path}/note").first()[0])
        return cls(spark, path, {n: (StructType.fromJson(s), k) for n, (s, k) in note["tables"].items()}, note["buckets"])

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> Manifest:
        """One row per table and bucket that holds rows: bounded by the store's settings, not by its rows."""
        try:
            every = self.spark.read.schema("name string, bucket int, version int, through int, at double, number int").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return Manifest(0, -1, 0.0, {})
        rows = every.join(every.agg(F.max("number").alias("number")), "number", "left_semi").collect()
        versions = {(r["name"], r["bucket"]): r["version"] for r in rows if r["name"]}
        return Manifest(rows[0]["number"], rows[0]["through"], rows[0]["at"], versions)

    def append(self, rows: dict[str, DataFrame], epoch: int) -> bool:
        """Write a batch; False if its epoch was merged already (a repeat that has nothing left to do)."""
        if epoch <= self.manifest().through:
            return False
        rows = {name: self.spark.createDataFrame([], schema) for name, (schema, _) in self.tables.items()} | rows

        def write(name: str, batch: DataFrame) -> None:
            batch.select(*self.tables[name][0].names).write.mode("overwrite").parquet(f"{self.path}/delta/{name}/{EPOCH}={epoch}")

        together(*[lambda name=name, batch=batch: write(name, batch) for name, batch in rows.items()])
        commit(self.spark, self.path, epoch)
        return True

    def waiting(self, state: Manifest | None = None, before: int | None = None) -> list[int]:
        """Committed epochs that are not merged, all or those ``before`` one: as many as batches since the last merge."""
        through = (state or self.manifest()).through
        found = committed(self.spark, self.path).filter(F.col(EPOCH) > through)
        return sorted(r[EPOCH] for r in found.collect() if before is None or r[EPOCH] < before)

    def delta(self, name: str, epochs: list[int]) -> DataFrame:
        """Rows of these epochs, with their epoch; only their folders are opened."""
        schema = StructType([*self.tables[name][0].fields, StructField(EPOCH, IntegerType())])
        home = f"{self.path}/delta/{name}"
        paths = [f"{home}/{EPOCH}={e}" for e in epochs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", home).option("ignoreMissingFiles", "true").parquet(*paths)

    def base(self, name: str, buckets: set[int] | None = None, state: Manifest | None = None) -> DataFrame:
        """Merged rows, of all buckets or of some; only these are opened."""
        state, schema = state or self.manifest(), self.tables[name][0]
        home = f"{self.path}/base/{name}"
        paths = [f"{home}/version={v}/bucket={b}" for (n, b), v in sorted(state.versions.items()) if n == name and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, key: str) -> set[int]:
        """Buckets of some keys: at most the number of buckets comes to the driver."""
        return {r["bucket"] for r in keys.select(self.bucket_of(F.col(key)).alias("bucket")).distinct().collect()}

    def pending(self, epochs: list[int]) -> int:
        """Rows of the waiting epochs, counted from file footers."""
        return sum(self.delta(name, epochs).count() for name in self.tables)

    def merge(self, combine: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, DataFrame]], before: int | None = None) -> bool:
        """Merge waiting epochs. ``combine`` gets the merged rows of the touched buckets and the waiting rows (with their
        epoch) of every table, and returns what these buckets hold from now on. False if nothing waits."""
        state = self.manifest()
        epochs = self.waiting(state, before)
        if not epochs:
            return False
        deltas = {name: self.delta(name, epochs) for name in self.tables}
        touched = {name: self.touched(deltas[name], key) for name, (_, key) in self.tables.items()}
        shared = {key: set().union(*(touched[n] for n, (_, k) in self.tables.items() if k == key)) for _, key in self.tables.values()}
        touched = {name: shared[key] for name, (_, key) in self.tables.items()}  # tables of one key change together
        number = state.number + 1
        merged = combine({name: self.base(name, touched[name], state) for name in self.tables}, deltas)
        versions = {(n, b): v for (n, b), v in state.versions.items() if b not in touched[n]}
        homes = {name: f"{self.path}/base/{name}/version={number}" for name in self.tables}

        def write(name: str, schema: StructType, key: str) -> None:
            rows = merged[name].select(*schema.names, self.bucket_of(F.col(key)).alias("bucket"))
            rows.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(homes[name])

        together(*[lambda n=n, s=s, k=k: write(n, s, k) for n, (s, k) in self.tables.items()])
        versions |= {(n, b): number for n in self.tables for b in touched[n] if self._holds(f"{homes[n]}/bucket={b}")}
        self._publish(Manifest(number, epochs[-1], time.time(), versions))
        self._clean(state)
        return True

    def _holds(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _publish(self, state: Manifest) -> None:
        rows = [(n, b, v, state.through, state.at) for (n, b), v in sorted(state.versions.items())] or [(None, None, None, state.through, state.at)]
        table = self.spark.createDataFrame(rows, "name string, bucket int, version int, through int, at double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/number={state.number}")  # one file: there or not

    def _clean(self, before: Manifest) -> None:
        """Drop what the state ``before`` the present one had replaced already: versions, batches, commits and its manifest."""
        older = before.number - 1
        try:
            old = self.spark.read.schema("name string, bucket int, version int, through int, at double").parquet(f"{self.path}/manifest/number={older}").collect()
        except AnalysisException:
            return
        for r in old:
            if r["name"] and before.versions.get((r["name"], r["bucket"])) != r["version"]:
                delete_folder(self.spark, f"{self.path}/base/{r['name']}/version={r['version']}/bucket={r['bucket']}")
        for epoch in [r[EPOCH] for r in committed(self.spark, self.path).filter(F.col(EPOCH) <= old[0]["through"]).collect()]:
            for name in self.tables:
                delete_folder(self.spark, f"{self.path}/delta/{name}/{EPOCH}={epoch}")
            delete_folder(self.spark, f"{self.path}/commits/{EPOCH}={epoch}")
        delete_folder(self.spark, f"{self.path}/manifest/number={older}")
