"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contentlake.session import checkpoint_folder
from contentlake.sources.tables import VIEWS, Lake

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def over(*views: str, **more: str) -> str:
    """A WITH clause that defines catalogue views and further named selects."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in views]
    parts += [f"{name} AS ({text.strip()})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None):
    """Register ``f(lake) -> DataFrame`` under ``name``."""

    def register(f: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Lake(spark, folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
