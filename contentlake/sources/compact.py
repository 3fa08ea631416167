"""Compact binary lists: 20-byte ids, 6-byte peers, 26-byte nodes.

A list is read as hex text; its fields are numbers in BIGINT. Lists are cut with ``sequence`` and
exploded, so the work stays in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.ids import hex_number
from contentlake.functions.net import is_routable
from contentlake.settings import DEFAULTS


def _chunks(binary: Column, size: int, most: int | None = None) -> Column:
    """Hex text of every whole ``size``-byte chunk; a trailing rest is ignored."""
    text, digits = F.lower(F.hex(binary)), 2 * size
    count = F.coalesce(F.floor(F.octet_length(binary) / size).cast("int"), F.lit(0))
    if most is not None:
        count = F.least(count, F.lit(most))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * digits + 1, F.lit(digits)))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<string>"))


def explode_ids(df: DataFrame, col: str, most: int = DEFAULTS.ids_per_response) -> DataFrame:
    """Rows (..., position, id); at most ``most`` ids per list."""
    other = [c for c in df.columns if c != col]
    return df.select(*other, F.posexplode(_chunks(F.col(col), 20, most)).alias("position", "id"))


def _addresses(chunks: Column, at: int) -> Column:
    """Chunks as structs (id, ip, port) with the invalid ones dropped; the address starts at hex ``at``."""
    parsed = F.transform(
        chunks,
        lambda c: F.struct(
            F.substring(c, 1, at - 1).alias("id"),
            hex_number(c, at, 8).alias("ip"),
            hex_number(c, at + 8, 4).alias("port"),
        ),
    )
    return F.filter(parsed, lambda p: is_routable(p["ip"], p["port"]))


def explode_peers(df: DataFrame, col: str, most: int) -> DataFrame:
    """Rows (..., position, ip, port) of valid peers; ``most`` counts valid ones only."""
    other = [c for c in df.columns if c != col]
    valid = F.slice(_addresses(_chunks(F.col(col), 6), 1), 1, most)
    return df.select(*other, F.posexplode(valid).alias("position", "_p")).select(*other, "position", "_p.ip", "_p.port")


def explode_nodes(df: DataFrame, col: str, most: int = DEFAULTS.nodes_per_response) -> DataFrame:
    """Rows (..., position, node_id, ip, port) of nodes with a valid address."""
    other = [c for c in df.columns if c != col]
    valid = F.slice(_addresses(_chunks(F.col(col), 26), 41), 1, most)
    exploded = df.select(*other, F.posexplode(valid).alias("position", "_p"))
    return exploded.select(*other, "position", F.col("_p.id").alias("node_id"), "_p.ip", "_p.port")
