"""Hard-negative mining by slot-decomposed selection.

A score is the inner product of integer vectors. An anchor's positives are its first rows of the same label, and each positive
opens a window of scores for negatives: from ``low`` to ``high`` percent of its own score. The upper limits of the
positives cut the scores into disjoint slots. Every task keeps the first k rows of each (anchor, slot) only, tasks are merged
slot by slot, and a window's answer is the head of its slot and all lower ones, read in descending order. So one pass over the
scores answers all the windows of an anchor, however they overlap.

Anchors and rows meet in a grid: blocks of anchors by groups of rows, each cell a stream that a task reads once. No side
is broadcast or collected, and a task holds one block of anchors and a bounded strip of scores.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlake.llm.common import parts, saved, scan

LEAST = -(1 << 63)  # no score: real ones are clamped to 64 bits above it
MOST = (1 << 63) - 1
STRIP = 1 << 22  # scores that a task holds at a time


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``width`` (the longest by default), padded with 0 or cut, and their lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return values.reshape(len(sizes), width), sizes
    out = np.zeros((len(sizes), width), values.dtype)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    used = np.minimum(sizes, width)
    row = np.repeat(np.arange(len(sizes)), used)
    place = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
    out[row, place] = values[begin[row] + place]
    return out, sizes


class Best:
    """The first k rows of each cell (anchor and slot) by score; rows are added in the order that breaks ties."""

    def __init__(self, cells: int, k: int):
        self.scores = np.full((cells, k), LEAST, np.int64)
        self.ids = np.zeros((cells, k), np.int64)
        self.known = np.zeros((cells, k), bool)

    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, cells: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        touched, own = np.unique(cells, return_inverse=True)
        k = self.scores.shape[1]
        cell = np.concatenate([np.repeat(np.arange(len(touched)), k), own])
        score = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((~score, cell))  # stable: rows kept before stand first
        rank = np.arange(len(order)) - np.searchsorted(cell[order], np.arange(len(touched)))[cell[order]]
        order = order[rank < k]
        shape = (len(touched), k)
        self.scores[touched] = score[order].reshape(shape)
        self.ids[touched] = np.concatenate([self.ids[touched].ravel(), ids])[order].reshape(shape)
        self.known[touched] = np.concatenate([self.known[touched].ravel(), known])[order].reshape(shape)


class Block:
    """Anchors of one cell of the grid and what they have found so far."""

    def __init__(self, table: pa.Table, k: int):
        def column(name):
            return table.column(name).combine_chunks()

        label = column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        vectors, sizes = matrix(column("vec"))
        self.vectors, self.sizes, self.label = vectors[order], sizes[order], label[order]
        self.anchor = column("anchor").to_numpy()[order]
        ids = column("id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
        self.ids = ids.fill_null(0).to_numpy()[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.most = np.abs(self.vectors).max(initial=0)
        self.single = self.vectors.astype(np.float32) if self.most < 1 << 24 else None
        limits, counts = matrix(column("upper"))
        slots = max(limits.shape[1], 1)
        self.upper = np.full((len(order), slots), LEAST, np.int64)
        if limits.shape[1]:
            self.upper[:] = np.where(np.arange(slots) < counts[:, None], limits, LEAST)[order]
        self.slots, self.last = slots, np.maximum(counts[order], 1) - 1
        self.floor = column("floor").fill_null(LEAST).to_numpy()[order]
        self.mined = bool(limits.shape[1])  # limits are known: look for negatives, else for positives
        self.best = Best(len(order) * slots, k)
        self.seen = 0

    def scores(self, own: slice, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """Exact scores of a slice of the anchors against rows, in the cheapest type that holds them, and a bound of that type."""
        bound = self.most * np.abs(vectors).max(initial=0) * max(vectors.shape[1], 1)
        if bound < 1 << 24 and self.single is not None:
            return self.single[own] @ vectors.astype(np.float32).T, 1 << 24
        if bound < 1 << 53:
            return self.vectors[own] @ vectors.T, 1 << 53
        rows = [[int(x) for x in v] for v in vectors]
        wide = [[sum(map(mul, map(int, v), r)) for r in rows] for v in self.vectors[own]]
        clamped = [[min(max(s, LEAST + 1), MOST) for s in row] for row in wide]
        return np.array(clamped, np.int64).reshape(len(wide), len(rows)), 1 << 63

    def same_row(self, label, ids, known, vectors, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) where the row is the anchor itself or a repeat of it."""
        first = np.searchsorted(self.sorted_ids, ids, "left")
        count = np.searchsorted(self.sorted_ids, ids, "right") - first
        row = np.repeat(np.arange(len(ids)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        anchor = self.by_id[place]
        equal = (self.label[anchor] == label[row]) & (self.sizes[anchor] == sizes[row]) & (self.known[anchor] == known[row])
        anchor, row = anchor[equal], row[equal]
        equal = (self.vectors[anchor] == vectors[row]).all(axis=1)
        return anchor[equal], row[equal]

    def read(self, batch: pa.RecordBatch) -> None:
        """Rows in the order of their ids."""
        vectors, sizes = matrix(batch.column("vec"), self.vectors.shape[1])
        label = batch.column("label").to_numpy()
        known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("id").fill_null(0).to_numpy()
        at = 0
        while at < len(ids):
            # Narrow strips at first: once the places are filled, nearly all scores fall short of the worst one kept.
            size = min(max(self.seen * 4, 64), max(STRIP // len(self.anchor), 64))
            part = slice(at, at + size)
            find = self.negatives if self.mined else self.positives
            find(label[part], ids[part], known[part], vectors[part], sizes[part])
            at += size
            self.seen += size

    def positives(self, label, ids, known, vectors, sizes) -> None:
        order = np.argsort(label, kind="stable")
        twin_anchor, twin_row = self.same_row(label, ids, known, vectors, sizes)
        runs = np.r_[0, np.flatnonzero(np.diff(label[order])) + 1, len(order)]
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            rows = order[a:b]
            own = slice(*(int(np.searchsorted(self.label, label[rows[0]], side)) for side in ("left", "right")))
            if own.start == own.stop:
                continue
            scores, bound = self.scores(own, vectors[rows])
            # An empty place takes any score, a filled one only a better one, since ids ascend.
            better = scores > np.maximum(self.best.worst()[own], -bound).astype(scores.dtype)[:, None]
            twins = (twin_anchor >= own.start) & (twin_anchor < own.stop)
            better[twin_anchor[twins] - own.start, np.searchsorted(rows, twin_row[twins])] = False
            anchor, row = np.nonzero(better)
            found = scores[anchor, row].astype(np.int64)
            self.best.add(anchor + own.start, found, ids[rows[row]], known[rows[row]])

    def negatives(self, label, ids, known, vectors, sizes) -> None:
        scores, bound = self.scores(slice(None), vectors)
        full = self.best.worst().reshape(-1, self.slots)[np.arange(len(self.last)), self.last]
        floor, top = np.maximum(self.floor, full), self.upper[:, 0]
        if bound < 1 << 60:
            floor, top = np.clip(floor, -bound, bound), np.clip(top, -bound, bound)
        inside = (scores > floor.astype(scores.dtype)[:, None]) & (scores <= top.astype(scores.dtype)[:, None])
        anchor, row = np.nonzero(inside)
        other = self.label[anchor] != label[row]
        anchor, row = anchor[other], row[other]
        found = scores[anchor, row].astype(np.int64)
        cell = anchor * self.slots + (self.upper[anchor] >= found[:, None]).sum(axis=1) - 1
        better = found > self.best.worst()[cell]
        self.best.add(cell[better], found[better], ids[row[better]], known[row[better]])

    def rows(self) -> dict:
        cell, place = np.nonzero(self.best.scores > LEAST)
        return {
            "anchor": self.anchor[cell // self.slots],
            "slot": (cell % self.slots).astype(np.int32),
            "score": self.best.scores[cell, place],
            "id": pa.array(self.best.ids[cell, place], mask=~self.best.known[cell, place]),
        }


def grid(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, k: int) -> DataFrame:
    """``(anchor, slot, score, id)``: the first ``k`` rows of each anchor and slot, merged over all cells of the grid."""
    spark = rows.sparkSession
    none = F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("upper"), F.lit(None).cast("long").alias("floor")
    left = anchors.select(
        F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(0).alias("kind"), "id", "label", "vec", "anchor", "upper", "floor",
    )
    # The place of a row, not its content, deals it out: repeated rows do not meet in one group.
    right = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    right = right.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "group", F.lit(1).alias("kind"), "id", "label", "vec", *none,
    )
    cells = left.union(right).repartition(max(parts(spark), blocks * groups // 4), "block", "group")
    cells = cells.sortWithinPartitions("block", "group", "kind", F.col("id").asc_nulls_last())

    def work(batches):
        waiting, block, cell = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "group", "kind")], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if cell != tuple(keys[a, :2]):
                    if block is not None:
                        yield block.rows()
                    waiting, block, cell = [], None, tuple(keys[a, :2])
                if keys[a, 2] == 0:
                    waiting.append(batch.slice(a, b - a))
                elif block is not None or waiting:
                    block = block or Block(pa.Table.from_batches(waiting), k)
                    waiting = []
                    block.read(batch.slice(a, b - a))
        if block is not None:
            yield block.rows()

    found = scan(cells, work, "anchor long, slot int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def repeats(anchors: DataFrame, positives: int) -> DataFrame:
    """``(anchor, score, id)``: a row for each repeat of an anchor, up to ``positives``, with its score against itself."""

    def work(batches):
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            copies = np.minimum(batch.column("copies").to_numpy() - 1, positives)
            score = [min(sum(int(x) * int(x) for x in v), MOST) for v in vectors]
            place = np.repeat(np.arange(len(copies)), copies)
            yield {"anchor": batch.column("anchor").take(place), "score": np.array(score, np.int64)[place], "id": batch.column("id").take(place)}

    return scan(anchors.filter("copies > 1").select("anchor", "id", "vec", "copies"), work, "anchor long, score long, id long")


def hard_negatives(
    rows: DataFrame,
    vec_id: Column,
    label: Column,
    vector: Column,
    anchor: Column,
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_anchors: int = 1 << 15,
    group_rows: int = 1 << 17,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    Each component x becomes floor(scale * x). A positive is one of the first ``positives`` other rows of the anchor's label;
    its negatives are the first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive.
    Higher scores come first, then smaller ids, a NULL id last. All anchors meet all rows.

    Rows with a NULL label or vector, or a component that is NULL or not finite once scaled, take no part. A NULL id is no
    anchor (unless ``anchor`` says so) but a candidate. Components past the end of the shorter vector count as 0. Repeated
    rows are rows of their own: an anchor's repeat is one of its other rows, and answers again as an anchor. Scores beyond
    64 bits are clamped. Tables without rows, anchors or positives give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(scale))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 62), F.floor(x).cast("double")).otherwise(x))
    finite = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    base = rows.filter(label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        vec_id.cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks")
    )
    own = base.filter("asks").groupBy("id", "label", "vec").agg(F.count("*").alias("copies"))
    anchors = saved(own.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    base = base.drop("asks")
    n, count = base.count(), max(anchors.count(), 1)
    blocks = -(-count // block_anchors)
    groups = max(-(-n // group_rows), min(-(-4 * parts(spark) // blocks), -(-n // 2048)), 1)

    no_limits = F.array().cast("array<long>").alias("upper"), F.lit(None).cast("long").alias("floor")
    near = grid(anchors.select("*", *no_limits), base, blocks, groups, positives).select("anchor", "score", "id")
    entry = F.struct((-F.col("score")).alias("key"), F.col("id").isNull().alias("open"), "id", "score")
    firsts = near.union(repeats(anchors, positives)).groupBy("anchor").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, positives).alias("firsts"))
    # Limits in whole numbers; a window whose lower limit lies above its upper one is empty.

    def limit(score: Column, percent: int, rounded) -> Column:
        found = rounded(score.cast("decimal(25,0)") * F.lit(percent) / F.lit(100))
        return F.greatest(F.least(found, F.lit(MOST)), F.lit(LEAST + 1)).cast("long")

    def lower(p: Column) -> Column:
        return limit(p["score"], low, F.ceil)

    def upper(p: Column) -> Column:
        return limit(p["score"], high, F.floor)

    window = F.transform("firsts", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"), lower(p).alias("lower"), upper(p).alias("upper")))
    window = F.filter(window, lambda w: w["lower"] <= w["upper"])
    asked = saved(anchors.join(firsts, "anchor").withColumn("windows", window).filter(F.size("windows") > 0), "windows")
    limits = asked.select(
        "anchor", "id", "label", "vec", F.col("windows.upper").alias("upper"), (F.array_min("windows.lower") - 1).alias("floor")
    )
    slots = grid(limits, base, blocks, groups, negatives)
    entry = F.struct("slot", (-F.col("score")).alias("key"), F.col("id").isNull().alias("open"), "id", "score")
    # Slots from high to low are scores in descending order, so a window reads on from its own slot until it has enough.
    merged = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    each = asked.select("anchor", F.col("id").alias("anchor_id"), "copies", F.posexplode("windows").alias("place", "w")).join(merged, "anchor")
    suffix = F.slice(F.filter("found", lambda c: c["slot"] >= F.col("place")), 1, negatives)
    each = each.withColumn("hits", F.filter(suffix, lambda c: c["score"] >= F.col("w.lower")))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("anchor_id", F.col("w.id").alias("positive_id"), "w.score", F.posexplode("hits").alias("at", "hit")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("hit.score").alias("negative_score"),
    )
