"""The stored catalogue: items, their files and the path prefixes, merged by key from batches (``sources.buckets``).

The last write wins: of an item's versions the one added last, then the later epoch, then the higher ``seq``. Files belong to a
version, so those of replaced versions go, also where the new version has none. Paths are kept as a prefix id, which
follows from the prefix itself, and a file name.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentlake.operators.dedup import first_rows
from contentlake.operators.normalise import encode_prefixes, rebuild_paths
from contentlake.settings import DEFAULTS
from contentlake.sources.buckets import Buckets
from contentlake.sources.ranged import EPOCH

KEY = "info_hash"


def fields(**kinds: str) -> StructType:
    return StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": k, "nullable": True, "metadata": {}} for n, k in kinds.items()]})


ITEMS = fields(info_hash="string", name="string", size_bytes="long", total_peers="integer", added_ts="timestamp", seq="long", version="integer")
FILES = fields(info_hash="string", version="integer", seq="long", file_index="integer", prefix_id="long", filename="string", size_bytes="long")
PREFIXES = fields(prefix_id="long", prefix="string")
TABLES = {"items": (ITEMS, KEY), "files": (FILES, KEY), "prefixes": (PREFIXES, "prefix_id")}

Frames = dict[str, DataFrame]


def combine(base: Frames, delta: Frames) -> Frames:
    """Base rows with the waiting versions merged in. Only keys of the batches are ranked or matched."""
    new = {name: rows.drop(EPOCH) for name, rows in delta.items()}
    keys = new["items"].select(KEY).distinct()
    versions = base["items"].join(keys, KEY, "left_semi").unionByName(new["items"])
    best = first_rows(versions, KEY, [F.desc("added_ts"), F.desc("version"), F.desc("seq")])
    own = base["files"].join(keys, KEY, "left_semi").unionByName(new["files"])
    own = own.join(best.select(KEY, "version", "seq"), [KEY, "version", "seq"], "left_semi")
    return {
        "items": base["items"].join(keys, KEY, "left_anti").unionByName(best),
        "files": base["files"].join(keys, KEY, "left_anti").unionByName(own),
        "prefixes": base["prefixes"].unionByName(new["prefixes"]).distinct(),
    }


class CatalogStore:
    """Batches of items(info_hash, name, size_bytes, total_peers, added_ts, seq) with files(info_hash, seq, file_index, path,
    size_bytes); ``seq`` parts the versions of a key within a batch."""

    def __init__(self, store: Buckets):
        self.store = store

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64) -> CatalogStore:
        return cls(Buckets.create(spark, path, TABLES, buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CatalogStore:
        return cls(Buckets.open(spark, path))

    @staticmethod
    def rows(items: DataFrame, files: DataFrame, epoch: int) -> Frames:
        """A batch as rows of the three tables."""
        version = F.lit(epoch).alias("version")
        encoded, prefixes = encode_prefixes(files)
        return {"items": items.select("*", version), "files": encoded.select("*", version), "prefixes": prefixes}

    def write(self, items: DataFrame, files: DataFrame, epoch: int) -> bool:
        """Add a batch; a repeated epoch replaces itself, or is left out once it was merged."""
        return self.store.append(self.rows(items, files, epoch), epoch)

    def flush(self, rows: int = DEFAULTS.batch_rows, seconds: float = DEFAULTS.flush_seconds, before: int | None = None) -> bool:
        """Merge the waiting batches if they hold ``rows`` items, or the last merge is ``seconds`` ago."""
        state = self.store.manifest()
        waiting = self.store.waiting(state, before)
        if not waiting or (time.time() - state.at < seconds and self.store.delta("items", waiting).count() < rows):
            return False
        return self.store.merge(combine, before)

    def current(self) -> Frames:
        """Items, files and prefixes as they are now, waiting batches included."""
        state = self.store.manifest()
        epochs = self.store.waiting(state)
        return combine({n: self.store.base(n, None, state) for n in TABLES}, {n: self.store.delta(n, epochs) for n in TABLES})

    def items(self) -> DataFrame:
        return self.current()["items"].drop("version", "seq")

    def files(self) -> DataFrame:
        """(info_hash, file_index, path, size_bytes)"""
        now = self.current()
        return rebuild_paths(now["files"].drop("version", "seq"), now["prefixes"]).select(KEY, "file_index", "path", "size_bytes")
