"""Master/detail tables: path splitting, the path-prefix dictionary and its inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.paths import join_path, path_filename, path_prefix
from contentlake.operators.frames import join_nullable
from contentlake.operators.ordering import number_rows


def split_paths(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("prefix", path_prefix(F.col(path))).withColumn("filename", path_filename(F.col(path)))


def _prefixes(files: DataFrame, path: str) -> DataFrame:
    """Unique prefixes; a map-side partial aggregate sends a hot prefix once per task."""
    return files.select(path_prefix(F.col(path)).alias("prefix")).filter("prefix IS NOT NULL").distinct()


def prefix_dictionary(files: DataFrame, path: str = "path") -> DataFrame:
    """(prefix_id, prefix): unique prefixes numbered 1.. in text order, without a global window."""
    return number_rows(_prefixes(files, path), ["prefix"], "prefix_id").select("prefix_id", "prefix")


def extend_dictionary(prefixes: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The numbered dictionary with unknown prefixes of ``files`` added after its highest id; old ids stay."""
    new = _prefixes(files, path).join(prefixes.select("prefix"), "prefix", "left_anti")
    numbered = number_rows(new, ["prefix"], "_n")
    highest = prefixes.agg(F.coalesce(F.max("prefix_id"), F.lit(0)).cast("bigint").alias("m")).first()["m"]
    return prefixes.select("prefix_id", "prefix").unionByName(numbered.select((F.col("_n") + highest).alias("prefix_id"), "prefix"))


def encode_numbered(files: DataFrame, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with nullable prefix_id and filename, dictionary (prefix_id, prefix)) with the ids of :func:`prefix_dictionary`;
    a given dictionary is extended.

    The join back is left to Catalyst: a small dictionary is broadcast by its size statistics, a large one is shuffled and
    AQE splits the hot prefixes.
    """
    prefixes = prefix_dictionary(files) if prefixes is None else extend_dictionary(prefixes, files)
    return join_nullable(split_paths(files), prefixes, "prefix").drop("prefix", "path"), prefixes


ID_DIGITS = 15  # hex digits of a digest that make an id


def content_id(prefix: Column, retry: int = 0) -> Column:
    """A prefix's id from its text alone: 60 bits of its MD5 digest. ``retry`` > 0 gives ids for prefixes that share one."""
    text = F.concat(prefix, F.lit(f"\0{retry}")) if retry else prefix
    return F.conv(F.substring(F.md5(text), 1, ID_DIGITS), 16, 10).cast("bigint")


def shared_ids(files: DataFrame, known: DataFrame | None = None, most: int = 1000, path: str = "path") -> DataFrame:
    """(prefix, prefix_id): the prefixes whose id differs from :func:`content_id`, because another prefix has that one.

    The list is nearly always empty; that it is short is checked, since every encoding reads it. Prefixes of the ``known``
    dictionary keep their ids, then the first in text order of those that share one.
    """
    spark, schema = files.sparkSession, "prefix string, prefix_id bigint"
    new = _prefixes(files, path)
    known = spark.createDataFrame([], "prefix_id bigint, prefix string") if known is None else known
    first = new.join(known.select("prefix"), "prefix", "left_anti").withColumn("prefix_id", content_id(F.col("prefix")))
    keeps = first.groupBy("prefix_id").agg(F.min("prefix").alias("keeps"), F.count(F.lit(1)).alias("n"))
    doubled = first.join(keeps.filter("n > 1"), "prefix_id").filter("prefix <> keeps").select("prefix")
    held = first.join(known.select("prefix_id"), "prefix_id", "left_semi").select("prefix")
    waiting = sorted(r["prefix"] for r in doubled.union(held).distinct().limit(most + 1).collect())
    moved = known.filter(F.col("prefix_id") != content_id(F.col("prefix"))).select("prefix", "prefix_id")
    found = [tuple(r) for r in moved.limit(most + 1).collect()]
    if len(waiting) + len(found) > most:
        raise ValueError(f"more than {most} prefixes share an id")
    ids = first.select("prefix_id").union(known.select("prefix_id")).distinct()
    used = {i for _, i in found}
    for retry in range(1, 100):
        if not waiting:
            return spark.createDataFrame(found, schema)
        tried = spark.createDataFrame([(p,) for p in waiting], "prefix string").withColumn("prefix_id", content_id(F.col("prefix"), retry))
        free = sorted(tuple(r) for r in tried.join(ids, "prefix_id", "left_anti").select("prefix", "prefix_id").collect())
        for prefix, number in free:
            if number not in used:
                used.add(number)
                found.append((prefix, number))
                waiting.remove(prefix)
    raise ValueError("no free ids are left")


def encode_prefixes(files: DataFrame, prefixes: DataFrame | None = None, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with nullable prefix_id and filename, dictionary (prefix_id, prefix)); a given dictionary is extended.

    An id follows from the prefix itself, so batches agree without numbering, and encoding is a pass over the files that
    moves nothing. ``shared`` lists prefixes whose id differs from the rule (see :func:`shared_ids`).
    """
    split = split_paths(files)
    own = content_id(F.col("prefix"))
    if shared is None:
        encoded = split.withColumn("prefix_id", own)
    else:
        encoded = join_nullable(split, shared, "prefix").withColumn("prefix_id", F.coalesce("prefix_id", own))
    new = encoded.filter("prefix IS NOT NULL").select("prefix_id", "prefix").distinct()
    dictionary = new if prefixes is None else prefixes.select("prefix_id", "prefix").union(new).distinct()
    return encoded.drop("prefix", "path"), dictionary


def rebuild_paths(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    joined = join_nullable(files, prefixes, "prefix_id")
    return joined.withColumn("path", join_path(F.col("prefix"), F.col("filename"))).drop("prefix", "prefix_id", "filename")
