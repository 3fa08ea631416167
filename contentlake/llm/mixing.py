"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key from a hash of its id and text. The keys are uniform, so their leading digits cut a
source into ranges of equal expected size; sums per range and a running sum over the ranges give every range its
place in the source's order. Only the range that holds the cut of a source is sorted. Whole epochs are a division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wn
from pyspark.sql import functions as F

from contentlake.llm.common import saved

BROADCAST_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, seed: str) -> Column:
    """32 hexadecimal digits; the same in every run."""
    blank = F.lit("")
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), blank), F.lit("|"), F.coalesce(text, blank)))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: the sum of all sizes shared by weight, no source above
    ``most`` times its size, the excess shared by weight among the others.

    That is ``least(most * size, level * weight)`` with one level for all: sources are taken in the order in which they reach
    their limit, and the level is the first that the next source can bear. One row per source is all that is sorted.
    """
    turn = F.pmod(F.row_number().over(Wn.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    reach = F.col("limit") / F.col("weight")
    order = Wn.orderBy("reach", F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("reach", reach)
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Wn.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Wn.currentRow, Wn.unboundedFollowing))
    total = F.sum("source_size").over(Wn.rowsBetween(Wn.unboundedPreceding, Wn.unboundedFollowing))
    ranked = ranked.withColumn("level", (total - full) / left)
    whole = order.rowsBetween(Wn.unboundedPreceding, Wn.unboundedFollowing)
    level = F.first(F.when(F.col("reach") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    target = F.least(F.col("limit").cast("double"), level * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def cuts(keyed: DataFrame, weights: tuple[int, ...], most: int, digits: int) -> DataFrame:
    """One row per source: its size, target, whole epochs, and the key at which the last epoch is cut, with the number of
    words of that key's rows that are still taken (``rest``) and the number of these rows (``copies``)."""
    span = F.substring("key", 1, digits)
    ranges = saved(keyed.groupBy("source", span.alias("span")).agg(F.sum("size").alias("words")), "ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("budget", budget).withColumn("epochs", epochs)
    aims = aims.withColumn("open", F.col("budget") - F.col("epochs") * F.col("source_size"))
    order = Wn.partitionBy("source").orderBy("span").rowsBetween(Wn.unboundedPreceding, Wn.currentRow)
    placed = ranges.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    same = placed["source"].eqNullSafe(aims["source"])
    held = placed.join(aims, same & (F.col("open") >= F.col("before")) & (F.col("open") < F.col("upto"))).select(
        placed["source"].alias("of"), placed["span"].alias("at"), "before", "open"
    )
    inside = keyed.join(held, keyed["source"].eqNullSafe(F.col("of")) & (span == F.col("at")))
    inside = inside.groupBy("source", "key", "size", "before", "open").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    order = Wn.partitionBy("source").orderBy("key", "size").rowsBetween(Wn.unboundedPreceding, Wn.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum(words).over(order)).withColumn("from", F.col("upto") - words)
    at = inside.filter("open >= from AND open < upto").select(
        F.col("source").alias("of"), F.col("key").alias("cut"), (F.col("open") - F.col("from")).alias("rest"), "copies"
    )
    table = aims.join(at, aims["source"].eqNullSafe(at["of"]), "left").select(
        aims["source"].alias("of"), "source_size", "target", "epochs", "cut", "rest", "copies"
    )
    table = saved(table, "cuts")
    # A row per source: broadcast up to a checked number of them, so that a hot source is not shuffled by its name.
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", digits: int = 3
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, epochs, key`` for every row of ``docs`` (doc_id, text, source).

    Size is the number of words (NULL: 0). Sources in code point order, NULL last, take the weights in turn. Together the
    sources get as many words as there are; none gets more than ``most`` times its own. ``taken`` counts the words that the
    mix takes from a document over all epochs: whole epochs, then in key order until the budget is spent; the document at the
    cut gives part of its words. Rows that repeat both id and text have one key; at the cut they share the rest
    evenly, rounded down. A source without words takes none. ``digits``: a source is cut into 16**digits key ranges.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        key_of(F.col("doc_id"), F.col("text"), seed).alias("key"),
    )
    keyed = saved(keyed, "keyed")
    table = cuts(keyed, weights, most, digits)
    part = F.when(F.col("cut").isNull() | (F.col("key") > F.col("cut")), F.lit(0))
    part = part.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.expr("rest DIV copies"))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    joined = keyed.join(table, keyed["source"].eqNullSafe(F.col("of")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "key")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", digits: int = 3
) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each once per epoch that takes it. A document at the cut is
    given whole; a source without words is left out."""
    text, source = F.col("text"), F.col("source").cast("string")
    keyed = docs.select(source.alias("source"), word_count(text).alias("size"), key_of(F.col("doc_id"), text, seed).alias("key"))
    table = cuts(saved(keyed, "keyed"), weights, most, digits)
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("row"), source.alias("source"), key_of(F.col("doc_id"), text, seed).alias("key"))
    last = F.col("cut").isNotNull() & ((F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("rest") > 0)))
    times = F.col("epochs") + F.when(last, 1).otherwise(0)
    held = held.join(table, held["source"].eqNullSafe(F.col("of"))).withColumn("times", times).filter("times > 0")
    return held.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
