"""Exact k-closest ids by XOR distance for many targets, without comparing all pairs.

Ids lie in the leaves of a tree of hex prefixes: a prefix of more than ``leaf`` ids is split at its next digit, however far
down its ids differ. The tree is a table of (prefix, ids below it). A target's search is a table too: it goes to the deepest prefix
of its own path that holds enough ids, and from there to the neighbours with the next digit flipped, nearest first, until
their counts add up to k. A neighbour that is itself split becomes a search one level further down, for the target
with that digit flipped. Nearly all searches end in the first round; each later one sees only targets still short of k.
A search knows how many nearer ids the others of its target hold, so what remains is an equi-join of searches with the leaves
below: each search ranks the ids of these by itself, and no target's candidates are brought together.

Counts, tree and searches stay tables; the driver learns the number of ids, and whether another round is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.ids import ID_HEX
from contentlake.session import pinned

DIGITS = (1, 15), (16, 15), (31, 10)  # an id as three numbers that a long holds
SHALLOW = 3  # prefixes this short number at most 16 + 16 ** 2 + 16 ** 3


def numbers(text: Column, names: str) -> list[Column]:
    return [F.conv(F.substring(text, at, n), 16, 10).cast("bigint").alias(name) for (at, n), name in zip(DIGITS, names, strict=True)]


def digit(text: Column, place: Column) -> Column:
    """The hex digit after the first ``place`` ones, as a number."""
    return F.conv(F.substring(text, place + 1, F.lit(1)), 16, 10).cast("int")


def shared_digits(a: str, b: str) -> Column:
    """Number of leading hex digits that two ids share."""
    places = F.sequence(F.lit(1), F.lit(ID_HEX))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1))), i).otherwise(n))


def split_ids(ids: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int] | None:
    """((id, prefix) of every id and its leaf, (prefix, parent, n, is_leaf) of every prefix, number of ids).

    The first level is the one where evenly spread ids would fill their leaves. A further pass sees the crowded prefixes
    only, and splits each behind all the digits that its ids share, so that a deep crowd costs one pass and not one per digit.
    """
    total = ids.count()
    if not total:
        return None
    depth = 1
    while 16 ** (depth + 1) * leaf <= total and depth < ID_HEX:
        depth += 1
    live, placed, nodes = ids.select("id", F.substring("id", 1, depth).alias("prefix"), F.substring("id", 1, depth - 1).alias("parent")), [], []
    while True:
        counts = live.groupBy("prefix", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        counts = pinned(counts.withColumn("is_leaf", F.col("n") <= leaf).withColumn("next", shared_digits("lo", "hi") + 1))
        if not nodes:  # above the first level
            above = counts.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("d"), "prefix", "n")
            start = [F.substring(F.col("prefix"), F.lit(1), F.col("d")).alias("prefix")]
            start.append(F.when(F.col("d") > 0, F.substring(F.col("prefix"), F.lit(1), F.col("d") - 1)).alias("parent"))
            nodes.append(above.groupBy(*start).agg(F.sum("n").alias("n")).withColumn("is_leaf", F.lit(False)))
        nodes.append(counts.select("prefix", "parent", "n", "is_leaf"))
        at = live.select("id", "prefix").join(counts.select("prefix", "is_leaf", "next"), "prefix")
        placed.append(at.filter("is_leaf").select("id", "prefix"))
        if counts.filter("NOT is_leaf").isEmpty():
            break
        deeper = F.substring(F.col("id"), F.lit(1), F.col("next")).alias("prefix")
        live = pinned(at.filter("NOT is_leaf").select("id", deeper, F.col("prefix").alias("parent")))
    return reduce(DataFrame.union, placed), pinned(reduce(DataFrame.union, nodes)), total


def on_path(asked: DataFrame, nodes: DataFrame, depths: list[int]) -> DataFrame:
    """``asked`` (target, v, need, ...) with the deepest prefix of ``v`` that holds ``need`` ids, as ``prefix``; ``depths``: the
    lengths that prefixes have."""
    columns = asked.columns
    steps = asked.withColumn("d", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", F.substring(F.col("v"), F.lit(1), F.col("d")))
    nodes = nodes.select("prefix", "n")
    short, long = (F.length("prefix") <= SHALLOW), (F.length("prefix") > SHALLOW)
    # All targets pass the shortest prefixes: these are few by their length, so they may travel to the targets.
    near = steps.filter(F.col("d") <= SHALLOW).join(F.broadcast(nodes.filter(short)), "prefix")
    far = steps.filter(F.col("d") > SHALLOW).join(nodes.filter(long), "prefix")
    enough = near.union(far).filter("n >= need")
    best = enough.groupBy(*columns).agg(F.max("d").alias("d"))
    return best.select(*columns, F.substring(F.col("v"), F.lit(1), F.col("d")).alias("prefix"))


def families(nodes: DataFrame, kid: Column) -> DataFrame:
    """(prefix, kids) of every split prefix, sixteen kids at most, and of every leaf, which is its own only kid."""
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("prefix")).agg(F.collect_list(kid).alias("kids"))
    return kids.union(nodes.filter("is_leaf").select("prefix", F.array(kid)))


def visited(found: DataFrame, kids: DataFrame) -> DataFrame:
    """``found`` (target, v, need, before, prefix) -> one row per kid that holds some of its nearest ids, with the kid as ``kid``;
    ``before`` then counts the target's ids that come ahead of the kid's.

    All ids of a nearer kid are nearer than those of a farther one, so neither kids nor ids of a target have to meet again.
    """
    # The kids differ in their last digit; all that comes before it is the same for them, whatever the target's digits there.
    last = F.length(F.element_at("kids", 1)["prefix"]) - 1
    each = found.join(kids, "prefix").withColumn("_last", last).withColumn("_digit", digit(F.col("v"), F.col("_last")))
    far = F.transform("kids", lambda x: F.struct(digit(x["prefix"], F.col("_last")).bitwiseXOR(F.col("_digit")).alias("far"), x["n"].alias("n"), x.alias("kid")))
    each = each.withColumn("_near", F.sort_array(far))
    zero = F.lit(0).cast("bigint")
    ahead = F.transform("_near", lambda x, i: F.struct(
        x["kid"].alias("kid"), F.aggregate(F.slice("_near", F.lit(1), i), zero, lambda n, y: n + y["n"]).alias("ahead")
    ))
    each = each.select("target", "v", "need", "before", F.explode(ahead).alias("_at")).filter("_at.ahead < need")
    need = F.least(F.col("_at.kid.n"), F.col("need") - F.col("_at.ahead"))
    return each.select("target", "v", need.alias("need"), (F.col("before") + F.col("_at.ahead")).alias("before"), "_at.kid")


def next_searches(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, v, need, before) for the split kids: ``v`` is the target with their digit, so that it lies below them."""
    kids = families(nodes, F.struct("prefix", "n", "is_leaf")).filter(F.exists("kids", lambda x: ~x["is_leaf"]))
    split = visited(found, kids).filter("NOT kid.is_leaf")
    flipped = F.concat(F.col("kid.prefix"), F.substring(F.col("v"), F.length("kid.prefix") + 1, F.lit(ID_HEX)))
    return split.select("target", flipped.alias("v"), "need", "before")


def settled(found: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(target, rank, m) of the ids in the leaves that are kids of what was found, ``m`` the distance's numbers and the id."""
    held = placed.groupBy("prefix").agg(F.collect_list("id").alias("ids"))
    kids = families(nodes.join(held, "prefix", "left"), F.struct("prefix", "n", "is_leaf", "ids"))
    at = visited(found, kids).filter("kid.is_leaf").withColumn("t", F.array(*numbers(F.col("target"), "xyz")))
    far = F.transform("kid.ids", lambda i: F.struct(*[c.bitwiseXOR(F.col("t")[p]).alias(a) for p, (a, c) in enumerate(zip("abc", numbers(i, "abc"), strict=True))], i.alias("id")))
    near = at.select("target", "before", F.posexplode(F.slice(F.sort_array(far), F.lit(1), F.col("need").cast("int"))).alias("place", "m"))
    return near.select("target", (F.col("before") + F.col("place") + 1).cast("int").alias("rank"), "m")


def closest(
    nodes: DataFrame, targets: DataFrame, k: int = 8, node_id: str = "node_id", target: str = "target", leaf: int | None = None
) -> DataFrame:
    """(target, rank, node_id, distance): the k nearest nodes per distinct target. Dropped nodes are to be filtered out beforehand.

    ``leaf`` bounds the ids under one prefix, and with it the candidates of a search (4 k by default).
    """
    leaf = leaf or 4 * k
    ids = pinned(nodes.select(F.col(node_id).alias("id")).filter("id IS NOT NULL").distinct())  # read by every pass below
    wanted = targets.select(F.col(target).alias("target")).filter("target IS NOT NULL").distinct()
    tree = split_ids(ids, leaf)
    if tree is None:
        return wanted.limit(0).select("target", F.lit(0).alias("rank"), F.lit("").alias("node_id"), F.lit("").alias("distance"))
    placed, known, total = tree
    depths = sorted(known.agg(F.collect_set(F.length("prefix"))).first()[0])  # forty-one at most
    none = F.lit(0).cast("bigint").alias("before")
    asked = wanted.select("target", F.col("target").alias("v"), F.lit(min(k, total)).cast("bigint").alias("need"), none)
    searches = []
    while True:
        searches.append(pinned(on_path(asked, known, depths)))
        asked = next_searches(searches[-1], known)
        if asked.isEmpty():
            break
    near = settled(reduce(DataFrame.union, searches), known, placed)
    distance = F.concat(*[F.lpad(F.lower(F.hex(F.col("m")[c])), n, "0") for c, (_, n) in zip("abc", DIGITS, strict=True)])
    return near.select("target", "rank", F.col("m.id").alias("node_id"), distance.alias("distance"))
