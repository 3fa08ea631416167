"""Session helpers: a local builder for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", name: str = "contentlake", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    folder is lost with its executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows and their partitioning stay fixed for every later use."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_HOLDING = RLock()


@contextmanager
def holding(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold until the end of a block; a second such block waits for the first."""
    with _HOLDING:
        before = {key: spark.conf.get(key, None) for key in conf}
        try:
            for key, value in conf.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)


def bytes_read(df: DataFrame) -> int:
    """Bytes of the stored tables that a frame reads, as its plan knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    tables = [leaf for leaf in map(leaves.apply, range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in tables)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark can write to, if it is there."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def together(*jobs: Callable[[], object]) -> None:
    """Run independent jobs side by side, so that small ones do not wait for each other; the first error is raised."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
        for done in [pool.submit(inherit(job)) for job in jobs]:
            done.result()
