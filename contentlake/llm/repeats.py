"""Windows of units (words or bytes) that occur more than once in a corpus, by super-k-mer partitioning.

1. Consecutive windows of a text that share a minimiser form a run. A run goes to the bucket of its minimiser as a hash of its
   content, with its place. Runs of equal content are decided there; all but the first of them need not travel.
2. Where one minimiser has runs of several contents, the first run of each travels as a packed string to the bucket, and
   a solver finds the equal windows among them exactly. A minimiser with more than ``most`` contents is *hot*: its runs go on as
   hashes of single windows, spread by that hash, so that no bucket depends on how common a minimiser is.
3. The spans found come back to their texts, which are cut.

All buckets are read piece by piece; of step 1 a task holds the distinct contents of a bucket. A document is its (doc_id, text):
rows equal in both are one document, rows of one id with different texts are ordered by a hash of the text. A NULL id counts as
the largest long. Texts without a window take part in nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import Counters, cell_flags, each_group, parts, saved, scan, squeeze, unsqueeze
from contentlake.llm.minimisers import super_runs

U64 = np.uint64
LAST = (1 << 63) - 1
CODES = W.byte_codes(fold=False)
PLACE = np.dtype([("id", "<i8"), ("tag", "<u4"), ("first", "<u4"), ("count", "<u4")])


class WordUnits:
    """Units are runs of anything but ASCII white space; the content of a run is its words joined by one space."""

    def __init__(self, part: W.Slice, gram: int):
        self.part, words = part, W.find_words(part)
        self.starts, self.ends, self.offsets = words
        sums = W.prefix_sums(CODES[part.data])
        hashes = W.run_hashes(sums, self.starts, self.ends)
        self.tags = W.run_hashes(sums, part.offsets[:-1], part.offsets[1:]).astype(np.uint32)
        self.grams = W.gram_hashes(hashes, gram)
        self.sums = W.prefix_sums(hashes)

    def content(self, first: int, end: int) -> bytes:
        raw = self.part.data[self.starts[first] : self.ends[end - 1]].tobytes()
        return b" ".join(raw.split())

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text.split()

    @staticmethod
    def joined(pieces: list[list[bytes]]) -> bytes:
        return b" ".join(chain.from_iterable(pieces))


class ByteUnits:
    """Units are the bytes of a text."""

    def __init__(self, part: W.Slice, gram: int):
        self.part, self.offsets = part, part.offsets
        self.sums = W.prefix_sums(CODES[part.data])
        starts = np.arange(max(0, len(part.data) - gram + 1))
        self.grams = W.run_hashes(self.sums, starts, starts + gram)
        self.tags = W.run_hashes(self.sums, part.offsets[:-1], part.offsets[1:]).astype(np.uint32)

    def content(self, first: int, end: int) -> bytes:
        return self.part.data[first:end].tobytes()

    @staticmethod
    def split(text: bytes) -> bytes:
        return text

    @staticmethod
    def joined(pieces: list[bytes]) -> bytes:
        return b"".join(pieces)


def runs_of(units, length: int, gram: int):
    """Runs of a slice with their minimiser hashes, and their places (unit counts within the text) but for the id."""
    runs = super_runs(units.grams, units.offsets, length, gram)
    places = np.zeros(len(runs.first), PLACE)
    places["tag"] = units.tags[runs.text]
    places["first"] = runs.first - units.offsets[runs.text]
    places["count"] = runs.last - runs.first + 1
    return runs, places


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def pack(places: np.ndarray) -> bytes:
    """Compressed with equal bytes of all places together: ids and counts of a piece hardly change."""
    return squeeze(places.view(np.uint8).reshape(-1, PLACE.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), np.uint8).reshape(PLACE.itemsize, -1).T.copy().view(PLACE)[:, 0]


def columns_of(rows: list[tuple], names: str) -> dict:
    return dict(zip(names.split(), map(list, zip(*rows, strict=True)) if rows else ([] for _ in names.split()), strict=True))


RUNS = "bucket int, anchors binary, contents binary, places binary"


def read_runs(docs: DataFrame, kind, length: int, gram: int, buckets: int, flush: int = 1 << 19) -> DataFrame:
    """Every run as (minimiser hash, content hash, place), packed by bucket of the minimiser."""

    def work(batches):
        held, count = [], 0

        def rows():
            anchors, contents, places = (np.concatenate(x) for x in zip(*held, strict=True))
            out = []
            for k, own in by_bucket(anchors, buckets):
                # Of the hash, 32 bits besides those of the bucket; a false match only makes a run travel.
                small = (anchors[own] >> U64(32)).astype(np.uint32)
                out.append((k, small.tobytes(), contents[own].tobytes(), pack(places[own])))
            return columns_of(out, "bucket anchors contents places")

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in W.slices(W.text_column(batch, "text")):
                units = kind(part, gram)
                runs, places = runs_of(units, length, gram)
                places["id"] = ids[part.lo : part.hi][runs.text]
                contents = W.run_hashes(units.sums, runs.first, runs.last + length)
                held.append((runs.hashes, contents, places))
                count += len(places)
                if count >= flush:
                    yield rows()
                    held, count = [], 0
        if count:
            yield rows()

    return scan(docs, work, RUNS)


def first_of_each(keys: list[np.ndarray], places: np.ndarray):
    """Order that puts equal keys together, earliest place first, and marks of the first of each key in that order."""
    order = np.lexsort((places["first"], places["tag"], places["id"], *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


class Fold:
    """The distinct keys of a bucket with their earliest places, and which of them have been met at other places."""

    def __init__(self, keys: int):
        self.keys = [np.zeros(0, U64) for _ in range(keys)]
        self.places = np.zeros(0, PLACE)
        self.again = np.zeros(0, bool)

    def add(self, keys: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Take in a piece; returns the places that are not the earliest of their key (each place once)."""
        keys = [np.concatenate([a, b.astype(U64)]) for a, b in zip(self.keys, keys, strict=True)]
        places = np.concatenate([self.places, places])
        again = np.concatenate([self.again, np.zeros(len(places) - len(self.again), bool)])
        order, new = first_of_each(keys, places)
        places, again = places[order], again[order]
        head = np.flatnonzero(new)
        later = ~new
        later[1:] &= places[1:] != places[:-1]  # a repeated row of one document is not another place
        if len(head):
            self.again = np.logical_or.reduceat(again | later, head)
        self.keys = [k[order][head] for k in keys]
        self.places = places[head]
        return places[later]


FOUND = "wanted boolean, hot boolean, places binary"


def match_runs(runs: DataFrame, keep_first: bool, most: int) -> DataFrame:
    """Decided runs (``wanted`` false), and runs whose content has to be looked at, packed."""

    def work(batches):
        fold = Fold(2)
        hot = np.zeros(0, U64)

        def give(places, wanted, is_hot):
            return {"wanted": [wanted], "hot": [is_hot], "places": [pack(places)]}

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("anchors", "contents", "places")), strict=True)
            pieces = [(np.frombuffer(a, np.uint32), np.frombuffer(c, U64), unpack(p)) for a, c, p in rows]
            anchors, contents, places = (np.concatenate(x) for x in zip(*pieces, strict=True))
            anchors = anchors.astype(U64)
            known = np.isin(anchors, hot)
            if known.any():
                yield give(places[known], True, True)
            later = fold.add([anchors[~known], contents[~known]], places[~known])
            if len(later):
                yield give(later, False, False)
            values, counts = np.unique(fold.keys[0], return_counts=True)
            if (counts > most).any():
                hot = np.union1d(hot, values[counts > most])
                out = np.isin(fold.keys[0], hot)
                yield give(fold.places[out], True, True)
                if not keep_first and (fold.again & out).any():
                    yield give(fold.places[fold.again & out], False, False)
                fold.keys = [k[~out] for k in fold.keys]
                fold.places, fold.again = fold.places[~out], fold.again[~out]
        if not keep_first and fold.again.any():
            yield give(fold.places[fold.again], False, False)
        _, inverse, counts = np.unique(fold.keys[0], return_inverse=True, return_counts=True)
        several = counts[inverse] > 1
        if several.any():
            yield give(fold.places[several], True, False)

    return each_group(runs.groupBy("bucket"), work, FOUND)


def by_text(found: DataFrame, more: str = "") -> DataFrame:
    """Packed places to one row per document: (id, tag, places)."""

    def spread(batches):
        for batch in batches:
            rows = []
            for hot, data in zip(batch.column("hot").to_pylist(), batch.column("places").to_pylist(), strict=True):
                places = unpack(data)
                places = places[np.lexsort((places["first"], places["tag"], places["id"]))]
                new = np.flatnonzero((places["id"][1:] != places["id"][:-1]) | (places["tag"][1:] != places["tag"][:-1])) + 1
                for a, b in pairwise([0, *new.tolist(), len(places)]):
                    if b > a:
                        own = places[a:b]
                        rows.append((int(own["id"][0]), int(own["tag"][0]), hot, np.stack([own["first"], own["count"]], axis=1).tobytes()))
            for k in range(0, len(rows), 5000):
                yield columns_of(rows[k : k + 5000], "id tag hot spans")

    spread_rows = scan(found.select("hot", "places"), spread, "id long, tag long, hot boolean, spans binary")
    packed = F.collect_list(F.struct("hot", "spans")).alias("spans")
    return spread_rows.groupBy("id", "tag").agg(packed)


def text_flags(found: DataFrame, bits: int) -> np.ndarray:
    """One flag per hash cell of (id, tag): a filter of fixed size on documents that have places in ``found``."""

    def work(batches):
        counters = Counters(bits)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                places = unpack(data)
                counters.add(np.unique(text_keys(places["id"], places["tag"])))
        blocks, cells = counters.rows()
        yield {"block": blocks, "cells": cells}

    return cell_flags(scan(found.select("places"), work, "block int, cells binary"), bits, lambda counts: counts > 0)


def text_keys(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return W.mix(ids.astype(np.int64).view(U64) ^ W.mix(tags.astype(U64) + U64(1)))


def flagged(docs: DataFrame, flags, bits: int) -> DataFrame:
    """(id, tag, text) of the documents whose flag is set."""

    def work(batches):
        for batch in batches:
            for ids, tags, texts, held in parts_of(batch, flags.value, bits):
                yield {"id": ids[held], "tag": tags[held], "text": [t for t, h in zip(texts, held, strict=True) if h]}

    return scan(docs, work, "id long, tag long, text binary")


def flagged_or_done(docs: DataFrame, flags, bits: int, kind) -> DataFrame:
    """As ``flagged``; documents whose flag is not set are finished rows (text NULL), since nothing of them is removed."""
    nothing = digest(kind, kind.split(b""), None)

    def work(batches):
        for batch in batches:
            for ids, tags, texts, held in parts_of(batch, flags.value, bits):
                done = [nothing if h else digest(kind, kind.split(t), None) for t, h in zip(texts, held, strict=True)]
                out = {"id": ids, "tag": tags, "text": [t if h else None for t, h in zip(texts, held, strict=True)]}
                yield out | {name: [d[name] for d in done] for name in nothing}

    return scan(docs, work, "id long, tag long, text binary, " + RESULT)


def parts_of(batch: pa.RecordBatch, marks: np.ndarray, bits: int):
    """Ids, tags, texts and flags of the slices of a batch."""
    ids = batch.column(0).to_numpy()
    column = W.text_column(batch, "text")
    texts = column.cast(pa.large_binary())
    for part in W.slices(column):
        tags = W.run_hashes(W.prefix_sums(CODES[part.data]), part.offsets[:-1], part.offsets[1:]).astype(np.uint32)
        own = ids[part.lo : part.hi]
        held = marks[text_keys(own, tags) >> U64(64 - bits)]
        yield own, tags.astype(np.int64), texts.slice(part.lo, part.hi - part.lo).to_pylist(), held


STRINGS = "kind int, bucket int, keys binary, places binary, contents binary, sizes binary"


def read_strings(held: DataFrame, kind, length: int, gram: int, buckets: int, flush: int = 1 << 22) -> DataFrame:
    """Contents of the wanted runs (kind 0) and window hashes of hot ones (kind 1), packed by bucket."""

    def work(batches):
        cold, warm, size = [], [], 0

        def rows():
            out = []
            if cold:
                anchors, places = np.array([a for a, _, _ in cold], U64), np.concatenate([p for _, p, _ in cold])
                for k, own in by_bucket(anchors, buckets):
                    texts = [cold[i][2] for i in own.tolist()]
                    sizes = np.array([len(t) for t in texts], np.uint32)
                    keys = (anchors[own] >> U64(32)).astype(np.uint32)
                    out.append((0, k, keys.tobytes(), pack(places[own]), squeeze(b"".join(texts)), squeeze(sizes.tobytes())))
            if warm:
                one, two, places = (np.concatenate(x) for x in zip(*warm, strict=True))
                for k, own in by_bucket(one, buckets):
                    keys = np.stack([one[own], two[own]])
                    out.append((1, k, keys.tobytes(), pack(places[own]), b"", b""))
            return columns_of(out, "kind bucket keys places contents sizes")

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "tag", "text", "spans")]
            for doc, tag, text, spans in zip(*columns, strict=True):
                data = np.frombuffer(text, np.uint8)
                units = kind(W.Slice(0, 1, data, np.array([0, len(data)])), gram)
                runs, places = runs_of(units, length, gram)
                places["id"], places["tag"] = doc, tag
                for span in spans:
                    firsts = np.frombuffer(span["spans"], np.uint32).reshape(-1, 2)[:, 0]
                    for k in np.searchsorted(runs.first, firsts).tolist():
                        a, b = int(runs.first[k]), int(runs.last[k])
                        if span["hot"]:
                            starts = np.arange(a, b + 1)
                            raw = units.sums[starts + length] - units.sums[starts]
                            one = W.run_hashes(units.sums, starts, starts + length)
                            two = W.mix(raw * W.powers(len(units.sums), W.INVERSE)[starts] ^ U64(0xA5A5A5A5A5A5A5A5))
                            own = np.repeat(places[k : k + 1], b - a + 1)
                            own["first"], own["count"] = starts, 1
                            warm.append((one, two, own))
                            size += 32 * len(own)
                        else:
                            cold.append((runs.hashes[k], places[k : k + 1], units.content(a, b + length)))
                            size += len(cold[-1][2])
                if size >= flush:
                    yield rows()
                    cold, warm, size = [], [], 0
        if cold or warm:
            yield rows()

    return scan(held, work, STRINGS)


def solve_strings(strings: DataFrame, solver: Callable[[list[bytes], int], list[np.ndarray]], length: int, keep_first: bool, chunk: int) -> DataFrame:
    """Spans found among the strings of each bucket. ``solver`` gets strings in order of place and returns for each the
    marks of its windows to remove; minimisers are solved together in chunks of about ``chunk`` bytes."""

    def solve(group):
        strings = [(places, text) for _, places, text in group]
        for (place, _), marks in zip(strings, solver([t for _, t in strings], length), strict=True):
            edges = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                yield (place[0], place[1], place[2] + a, b - a)

    def give(rows):
        out = np.array(rows, PLACE) if isinstance(rows, list) else rows
        return {"wanted": [False], "hot": [False], "places": [pack(out)]}

    def work(batches):
        fold, group = Fold(2), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kind", "keys", "places", "contents", "sizes")]
            for kind, keys, places, contents, sizes in zip(*columns, strict=True):
                places = unpack(places)
                if kind == 1:
                    later = fold.add(list(np.frombuffer(keys, U64).reshape(2, -1)), places)
                    if len(later):
                        yield give(later)
                    continue
                ends = np.cumsum(np.frombuffer(unsqueeze(sizes), np.uint32).astype(np.int64))
                text = unsqueeze(contents)
                group += zip(
                    np.frombuffer(keys, np.uint32).tolist(), places.tolist(),
                    (text[a:b] for a, b in pairwise([0, *ends.tolist()])), strict=True,
                )
        if not keep_first and fold.again.any():
            yield give(fold.places[fold.again])
        group.sort()
        group = [g for k, g in enumerate(group) if k == 0 or g[:2] != group[k - 1][:2]]  # repeated rows of one document
        lo, size = 0, 0
        for hi in range(len(group)):
            if size >= chunk and group[hi][0] != group[hi - 1][0]:
                found = list(solve(sorted(group[lo:hi], key=lambda g: g[1])))
                if found:
                    yield give(found)
                lo, size = hi, 0
            size += len(group[hi][2])
        found = list(solve(sorted(group[lo:], key=lambda g: g[1])))
        if found:
            yield give(found)

    return each_group(strings.groupBy("kind", "bucket"), work, FOUND)


def removed_mask(count: int, spans: list, length: int) -> np.ndarray:
    """Marks of the units under removed windows."""
    steps = np.zeros(count + 1, np.int64)
    for span in spans:
        pairs = np.frombuffer(span["spans"], np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(steps, pairs[:, 0], 1)
        np.add.at(steps, pairs[:, 0] + pairs[:, 1] - 1 + length, -1)
    return np.cumsum(steps[:-1]) > 0


def digest(kind, units, mask: np.ndarray | None) -> dict:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])) if mask is not None else np.zeros(0, np.int64)
    starts, ends = edges[::2].tolist(), edges[1::2].tolist()
    kept = [units[a:b] for a, b in zip([0, *ends], [*starts, len(units)], strict=True)]
    return {
        "n": len(units),
        "n_removed": sum(ends) - sum(starts),
        "n_spans": len(starts),
        "kept_sha256": hashlib.sha256(kind.joined(kept)).hexdigest(),
        "spans": [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)],
    }


RESULT = "n long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def remove_repeats(
    docs: DataFrame, kind, length: int, gram: int, solver, keep_first: bool, most: int, chunk: int, flag_bits: int
) -> DataFrame:
    """``doc_id, n, n_removed, n_spans, kept_sha256, spans`` for every row of ``docs`` (doc_id, text): units, units under a
    window that also starts earlier (or, without ``keep_first``, anywhere else), maximal removed runs and what is left."""
    spark = docs.sparkSession
    buckets = parts(spark, 4)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text"))
    found = saved(match_runs(read_runs(keyed, kind, length, gram, buckets), keep_first, most), "runs")
    wanted = found.filter("wanted")
    marks = spark.sparkContext.broadcast(text_flags(wanted, flag_bits))
    held = flagged(keyed, marks, flag_bits).join(by_text(wanted), ["id", "tag"])
    strings = read_strings(held, kind, length, gram, buckets)
    solved = saved(solve_strings(strings, solver, length, keep_first, chunk), "solved")
    spans = found.filter("NOT wanted").union(solved)
    marks = spark.sparkContext.broadcast(text_flags(spans, flag_bits))
    rows = flagged_or_done(keyed, marks, flag_bits, kind)
    done = rows.filter("text IS NULL").drop("text", "tag")
    open_rows = rows.filter("text IS NOT NULL").select("id", "tag", "text").join(by_text(spans), ["id", "tag"], "left")

    def cut(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "text", "spans")]
            out = []
            for doc, text, spans in zip(*columns, strict=True):
                units = kind.split(text)
                mask = removed_mask(len(units), spans, length) if spans else None
                out.append({"id": doc} | digest(kind, units, mask))
            yield {k: [r[k] for r in out] for k in ("id", "n", "n_removed", "n_spans", "kept_sha256", "spans")}

    result = done.unionByName(scan(open_rows, cut, "id long, " + RESULT))
    return result.select(F.expr(f"nullif(id, {LAST})").alias("doc_id"), *[c for c in result.columns if c != "id"])
