"""Running values and row numbers over long ordered series, without one task per key.

A window partitioned by key sends a hot key to a single task. Here a key's rows fall into pieces by the time they carry (a slot of
``width`` seconds or units), which any pass over the rows finds again by itself: nothing is pinned and no row is numbered.
Each piece is summarised as a step (hold or set a value, add to a run, scale and add), the steps of a key are composed over
its pieces, one short row each, and what a piece starts with is joined back. Rows move once, by (key, piece); the local
windows and the join share that shuffle. A key's summary is as long as the time it covers, whatever its number of rows.

Global row numbers have no time to cut by: they use pinned pieces of a range partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from contentlake.session import pinned

PIECE = "_piece"
PIECE_ROWS = 1 << 20


def cut_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows in pinned contiguous pieces of (keys, order); ``order`` must break all ties, keys not be NULL.

    ``monotonically_increasing_id`` is the partition number and the row's place in the sorted
    partition, so dividing it numbers the pieces in global order.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    sorted_rows = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    place = F.monotonically_increasing_id()
    return pinned(sorted_rows.withColumn(PIECE, F.floor(place / piece_rows)))


SLOT = 86_400


def slot_of(df: DataFrame, order: Sequence[str], width: int) -> Column:
    """The piece of a row by its first order column, a number or a time; NULL sorts first."""
    kind = df.schema[order[0]].dataType
    value = F.col(order[0])
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        value = F.unix_timestamp(value.cast("timestamp"))
    elif not isinstance(kind, NumericType):
        raise TypeError(f"pieces are cut by a number or a time, {order[0]} is {kind.simpleString()}")
    return F.coalesce(F.floor(value / width).cast("bigint"), F.lit(-(1 << 63)))


def _carried(summary: DataFrame, keys: Sequence[str], carry: Column, name: str) -> DataFrame:
    """Per (key, piece) the value carried in from earlier pieces of the same key, where there is one.

    ``summary`` holds one row per (key, piece). Only keys present in several pieces matter, and
    those are found by a partial aggregate before the small window.
    """
    spanning = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pieces")).filter("_pieces > 1")
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.join(spanning.drop("_pieces"), list(keys), "left_semi")
    return carried.select(*keys, PIECE, carry.over(earlier).alias(name)).filter(F.col(name).isNotNull())


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = SLOT) -> DataFrame:
    """Running last non-null ``value`` per key, the current row included; ``order`` must break all ties, keys not be NULL.

    A piece either sets the value (to its last one) or holds what it was given.
    """
    rows = df.withColumn(name, value).withColumn(PIECE, slot_of(df, order, width))
    summary = rows.groupBy(*keys, PIECE).agg(F.max(F.when(F.col(name).isNotNull(), F.struct(*order, name)))[name].alias(name))
    carried = _carried(summary, keys, F.last(name, ignorenulls=True), "_carry")
    local = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*keys, PIECE], "left")
        .withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(local), "_carry"))
        .drop(PIECE, "_carry")
    )


def run_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, name: str, width: int = SLOT) -> DataFrame:
    """Per key the number of consecutive rows with ``hit`` up to and including each row.

    A piece either breaks the run (and ends with its own tail) or adds all its rows to it.
    """
    rows = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn(PIECE, slot_of(df, order, width))
    local = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The place in the piece, less the place of its last miss: hits after that one form the run.
    rows = rows.withColumn("_place", F.count(F.lit(1)).over(local))
    rows = rows.withColumn("_missed", F.max(F.when(~F.col("_hit"), F.col("_place"))).over(local))
    ends = rows.groupBy(*keys, PIECE).agg(F.max("_place").alias("_rows"), F.max("_missed").alias("_missed"))
    tail = (F.col("_rows") - F.coalesce("_missed", F.lit(0))).alias("_tail")
    summary = ends.select(*keys, PIECE, tail, F.col("_missed").isNotNull().alias("_broken"))
    breaks = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_breaks", F.sum(F.col("_broken").cast("int")).over(breaks))
    since = Window.partitionBy(*keys, "_breaks").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_running", F.sum("_tail").over(since))
    carried = _carried(summary, keys, F.last("_running"), "_carry")
    own = F.col("_place") - F.coalesce("_missed", F.lit(0))
    before = F.when(F.col("_missed").isNull() & F.col("_carry").isNotNull(), F.col("_carry")).otherwise(0)
    return rows.join(carried, [*keys, PIECE], "left").withColumn(name, own + before).drop(PIECE, "_hit", "_place", "_missed", "_carry")


def _composed(steps: DataFrame, by: Sequence[str], order: Sequence[str], reach: int) -> DataFrame:
    """Steps ``_add + _scale * x`` composed with all earlier ones of the same ``by``: running ``_add`` and ``_scale``.

    Eight neighbouring spans become one in each pass, up to ``reach`` rows back: one sort, and few passes.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    span = 1
    while span < reach:
        earlier = [F.lag(F.struct("_add", "_scale"), k * span).over(window).alias(f"_lag{k}") for k in range(1, 8)]
        steps = steps.select("*", *earlier)
        add, scale = F.lit(0.0), F.lit(1.0)
        for k in range(7, 0, -1):  # from the farthest span to the row itself
            own_add, own_scale = F.coalesce(f"_lag{k}._add", F.lit(0.0)), F.coalesce(f"_lag{k}._scale", F.lit(1.0))
            add, scale = own_add + own_scale * add, own_scale * scale
        steps = steps.withColumns({"_add": F.col("_add") + F.col("_scale") * add, "_scale": F.col("_scale") * scale})
        steps = steps.drop(*[f"_lag{k}" for k in range(1, 8)])
        span *= 8
    return steps


def smoothed(df: DataFrame, key: str, order: Sequence[str], x: Column, alpha: float, name: str, width: int = SLOT) -> DataFrame:
    """Per key the running average of ``x``: the first value seeds, then alpha x + (1 - alpha) previous.

    A row is the step ``alpha x + (1 - alpha) y`` on the average ``y`` so far. Rows compose inside runs of a piece as one
    weighted running sum (runs are short enough that the weights stay within a double), runs inside their piece and pieces
    inside their key by doubling. Seeding is starting with the first value. ``order`` must break all ties.
    """
    keep = 1.0 - alpha
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha lies above 0 and at most at 1")
    if keep == 0.0:
        return df.withColumn(name, x.cast("double"))
    run = max(1, min(256, int(200 / -math.log10(keep))))
    reach = math.ceil(746 / -math.log(keep))  # steps after which what came before has vanished from any double
    piece = [key, PIECE]
    local = Window.partitionBy(*piece).orderBy(*order)
    rows = df.withColumn("_x", x.cast("double")).withColumn(PIECE, slot_of(df, order, width))
    rows = rows.withColumn("_place", F.row_number().over(local) - 1)
    rows = rows.withColumn("_run", F.floor(F.col("_place") / run)).withColumn("_place", F.col("_place") % run)
    inside = Window.partitionBy(*piece, "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(keep), F.col("_place"))
    rows = rows.withColumn("_add", weight * F.sum(alpha * F.col("_x") / weight).over(inside)).withColumn("_scale", weight * keep)
    ends = rows.groupBy(*piece, "_run").agg(
        F.max_by(F.struct("_add", "_scale"), "_place").alias("_end"), F.min_by("_x", "_place").alias("_first")
    )
    steps = _composed(ends.select(*piece, "_run", "_first", "_end.*"), piece, ["_run"], reach)
    before = F.lag(F.struct("_add", "_scale")).over(Window.partitionBy(*piece).orderBy("_run"))
    none = F.struct(F.lit(0.0).alias("_add"), F.lit(1.0).alias("_scale"))
    steps = steps.withColumn("_before", F.coalesce(before, none))
    pieces = steps.groupBy(*piece).agg(
        F.max_by(F.struct("_add", "_scale"), "_run").alias("_end"), F.min_by("_first", "_run").alias("_first"),
        F.array_sort(F.collect_list(F.struct("_run", "_before"))).alias("_runs"),
    )
    whole = _composed(pieces.select(*piece, "_runs", "_first", "_end.*"), [key], [PIECE], reach)
    along = Window.partitionBy(key).orderBy(PIECE)
    seed = F.first("_first").over(along)
    earlier = F.lag(F.struct("_add", "_scale")).over(along)
    given = F.coalesce(F.col("_given._add") + F.col("_given._scale") * F.col("_seed"), F.col("_seed"))
    starts = whole.withColumn("_seed", seed).withColumn("_given", earlier).select(*piece, "_runs", given.alias("_start"))
    out = rows.join(starts, piece)
    own = F.get("_runs", F.col("_run").cast("int"))["_before"]
    carry = own["_add"] + own["_scale"] * F.col("_start")
    return out.select(*df.columns, (F.col("_add") + F.col("_scale") * carry).alias(name))


def number_rows(df: DataFrame, order: Sequence[str], name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Consecutive 1-based numbers in global order."""
    rows = cut_by_range(df, [], order, piece_rows)
    sizes = rows.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per piece: a millionth of the rows, and a running sum over them
    before = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PIECE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(PIECE).orderBy(*order)
    return (
        rows.join(offsets, PIECE)
        .withColumn(name, (F.row_number().over(local) + F.col("_before")).cast("bigint"))
        .drop(PIECE, "_before")
    )
