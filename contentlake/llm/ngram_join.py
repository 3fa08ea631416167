"""N-gram Jaccard join over token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct ``size``-word shingles. Shingles are ordered rare before
frequent. Two sets of Jaccard similarity t differ in at most ``n - ceil(t n)`` members of each, so:

* if a set has more rare shingles than that, its first ``errors + 1`` rare shingles are its prefix, and each is a
  signature by itself;
* otherwise the prefix holds all rare shingles and goes on into the frequent ones. These fall into classes by hash,
  and within a class *pairs* of shingles are the signatures. A class with c members in the prefix loses its last
  common pair only after c - 1 differences, so the prefix grows until ``rare + sum(c - 1)`` passes the errors.

Similar sets share a signature. How many classes there are depends on the size of the sets, so a set that goes into its
frequent shingles does so for its own size level and the next one; similar sets are at most one level apart.

Sets that share a signature meet in the cell of the smallest set of that signature, per size level, in bounded blocks.
There bit maps of the sets (two bits or more per member) bound every intersection from above, which drops pairs that
only share a passage. What stays falls into clusters; each set of a cluster travels once to it (once per block pair
of a large one) and is compared exactly. Only spanning forests leave a block. Equal sets are one node from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import Counters, cell_flags, components, each_group, each_run, parts, saved, scan

U64 = np.uint64
#: Size levels grow by this factor; it is not below 1 / threshold.
LEVEL = 1.25
SMALL = 8  # sets below this size use single shingles throughout


def level_of(n: int) -> int:
    return int(math.log(n) / math.log(LEVEL) + 1e-9)


def shingle_sets(part: W.Slice, size: int):
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle, none make an empty set."""
    words = W.find_words(part)
    hashes = W.word_hashes(part, words, W.byte_codes(fold=True))
    grams = W.gram_hashes(hashes, size)
    for a, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if e - a >= size:
            yield np.unique(grams[a : e - size + 1])
        elif e > a:
            yield W.gram_hashes(hashes[a:e], e - a) + U64(e - a)
        else:
            yield np.zeros(0, U64)


def fingerprint(members: np.ndarray) -> int:
    """One signed 64-bit id of a set."""
    total = W.mix(members).sum(dtype=U64) ^ W.mix(np.array([len(members)], U64))[0]
    return int(W.mix(np.array([total], U64)).view(np.int64)[0])


def signatures(members: np.ndarray, frequent: np.ndarray, errors: int) -> np.ndarray:
    """Signature hashes of a sorted set; ``frequent`` marks its members."""
    rare = members[~frequent]
    if len(rare) > errors:
        return rare[: errors + 1]
    common, need, level = members[frequent], errors + 1 - len(rare), level_of(len(members))
    found = [rare]
    for at in (level, level + 1):
        least = LEVEL**at
        if least < SMALL:
            found.append(W.mix(common[:need] + U64(at)))
            continue
        classes = W.mix(common) % U64(least / 4)
        order = np.argsort(classes, kind="stable")
        ordered = classes[order]
        follows = np.empty(len(common), bool)  # not the first of its class: one more difference is borne
        follows[order] = np.r_[False, ordered[1:] == ordered[:-1]]
        length = int(np.searchsorted(np.cumsum(follows), need)) + 1
        order = order[order < length]
        ordered = classes[order]
        for step in range(1, len(order)):
            at_step = np.flatnonzero(ordered[step:] == ordered[:-step])
            if len(at_step) == 0:
                break
            pair = W.mix(common[order[at_step]]) + common[order[at_step + step]]
            found.append(W.mix(pair ^ U64(at + 1)))
    return np.unique(np.concatenate(found))


def errors_of(n: int, percent: int) -> int:
    """Members of a set of n that a similar set may lack."""
    return n - (n * percent + 99) // 100


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def similar_pairs(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """All similar pairs of a block as a boolean matrix: incidence columns of shared members are multiplied in strips."""
    count = len(sets)
    if count <= 4:
        out = np.zeros((count, count), bool)
        for i in range(count):
            for j in range(i):
                out[i, j] = out[j, i] = alike(sets[i], sets[j], percent)
        return out
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    column, owner = column[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((count, count), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        strip = np.zeros((count, columns), np.float32)
        strip[owner[lo:hi], column[lo:hi] - start] = 1
        common += strip @ strip.T  # whole numbers below 2**24 are exact in float32
    union = sizes[:, None] + sizes[None, :] - common
    return 100 * common >= percent * union


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a boolean matrix, each to the first member of its tree."""
    seen, out = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        wave = np.array([root])
        while len(wave):
            wave = np.flatnonzero(linked[wave].any(axis=0) & ~seen)
            seen[wave] = True
            out += [(root, int(k)) for k in wave]
    return out


def bit_map(members: np.ndarray) -> bytes:
    """Members hashed into a power of two of bits, two to four for each."""
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    cells = np.zeros(bits, bool)
    cells[(members >> U64(20)) & U64(bits - 1)] = True
    return np.packbits(cells).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A bit map brought to ``size`` bytes: equal low bits fall together."""
    cells = np.frombuffer(data, np.uint8)
    return np.bitwise_or.reduce(cells.reshape(-1, size), axis=0)


def possible_pairs(maps: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of pairs whose bit maps do not rule out similarity: |a & b| is at most the common bits and the
    members that share a bit with others of their set."""
    bits = np.stack([folded(m, min(map(len, maps))) for m in maps])
    extra = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    out = np.zeros((len(maps), len(maps)), bool)
    for k in range(len(maps)):
        common = np.bitwise_count(bits[k] & bits).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(extra, extra[k]), np.minimum(sizes, sizes[k]))
        out[k] = 100 * most >= percent * (sizes + sizes[k] - most)
    return out


def read_profile(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Per document id, set size, fingerprint and bit map of its set; per task counts of shingle hashes."""

    def work(batches):
        counters = Counters(bits)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            ns, prints, maps = [], [], []
            for part in W.slices(W.text_column(batch, "text")):
                for members in shingle_sets(part, size):
                    counters.add(members)
                    ns.append(len(members))
                    prints.append(fingerprint(members) if len(members) else None)
                    maps.append(bit_map(members) if len(members) else None)
            none = [None] * len(ids)
            yield {"doc_id": ids, "n": ns, "print": prints, "map": maps, "block": none, "cells": none}
        blocks, cells = counters.rows()
        none = [None] * len(blocks)
        yield {"doc_id": none, "n": none, "print": none, "map": none, "block": blocks, "cells": cells}

    return scan(docs, work, "doc_id long, n long, print long, map binary, block int, cells binary")


def read_signatures(docs: DataFrame, size: int, percent: int, flags, bits: int, buckets: int, flush: int = 1 << 20) -> DataFrame:
    """Packed (signature, set) entries by bucket, repeats within a task's piece removed."""

    def work(batches):
        frequent = flags.value
        shift = U64(64 - bits)
        found, owners, held = [], [], 0

        def rows():
            sig, own = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]
            sig, own = sig[new], own[new]
            bucket = (sig % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            spans = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return {
                "bucket": [k for k, _ in spans],
                "sigs": [sig[s].tobytes() for _, s in spans],
                "prints": [own[s].tobytes() for _, s in spans],
            }

        for batch in batches:
            for part in W.slices(W.text_column(batch, "text")):
                for members in shingle_sets(part, size):
                    if len(members):
                        sig = signatures(members, frequent[members >> shift], errors_of(len(members), percent))
                        found.append(sig)
                        owners.append(np.full(len(sig), fingerprint(members), np.int64))
                        held += len(sig)
                if held >= flush:
                    yield rows()
                    found, owners, held = [], [], 0
        if held:
            yield rows()

    return scan(docs, work, "bucket int, sigs binary, prints binary")


def meet(entries: DataFrame, limit: int = 1 << 22) -> DataFrame:
    """``(hub, print, moved)``: each set of a shared signature with the smallest set of that signature, its hub.

    A bucket is read piece by piece. When ``limit`` entries wait they are handed on under the hubs known by then, so a
    signature that a large share of all sets has in common is never held whole; a hub that a later piece lowers is
    reported at the end as ``moved`` from the old one (``print``) to the final one, and its cell moves along.
    """

    def work(batches):
        sigs, hubs = np.zeros(0, U64), np.zeros(0, np.int64)
        waiting, held, used = [], 0, []

        def settle():
            nonlocal sigs, hubs
            all_s = np.concatenate([sigs, *(s for s, _ in waiting)])
            all_p = np.concatenate([hubs, *(p for _, p in waiting)])
            order = np.lexsort((all_p, all_s))
            all_s, all_p = all_s[order], all_p[order]
            head = np.flatnonzero(np.r_[True, all_s[1:] != all_s[:-1]]) if len(all_s) else np.zeros(0, np.int64)
            hub = np.repeat(all_p[head], np.diff(np.r_[head, len(all_s)]))
            other = hub != all_p
            sigs, hubs = all_s[head], all_p[head]
            return all_s[other], np.unique(np.stack([hub[other], all_p[other]], 1), axis=0)

        for batch in batches:
            for s, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                waiting.append((np.frombuffer(s, U64), np.frombuffer(p, np.int64)))
                held += len(waiting[-1][0])
                if held >= limit:
                    given, pairs = settle()
                    given = np.unique(given)
                    used.append((given, hubs[np.searchsorted(sigs, given)]))
                    waiting, held = [], 0
                    yield {"hub": pairs[:, 0], "print": pairs[:, 1], "moved": np.zeros(len(pairs), bool)}
        _, pairs = settle()
        yield {"hub": pairs[:, 0], "print": pairs[:, 1], "moved": np.zeros(len(pairs), bool)}
        for given, old in used:
            final = hubs[np.searchsorted(sigs, given)]
            moves = np.unique(np.stack([final[final != old], old[final != old]], 1), axis=0)
            yield {"hub": moves[:, 0], "print": moves[:, 1], "moved": np.ones(len(moves), bool)}

    return each_group(entries.groupBy("bucket"), work, "hub long, print long, moved boolean")


def cells_of(met: DataFrame, nodes: DataFrame, block_sets: int, block_members: int) -> DataFrame:
    """``(hub, level, i, j, print, own)``: which sets are compared in which block pair of which cell.

    A set joins its own level and, as the smaller side, the next one. A cell level counts only if two sets are there
    and one is of that level.
    """
    seen = met.filter("NOT moved").select("hub", "print").distinct()
    moved = met.filter("moved").selectExpr("print AS hub", "hub AS final").distinct()
    late = seen.join(moved, "hub").selectExpr("final AS hub", "print")
    members = seen.union(late).union(seen.selectExpr("hub", "hub AS print")).distinct()
    level = F.floor(F.log(F.col("n")) / F.lit(math.log(LEVEL)) + F.lit(1e-9)).cast("int")
    levels = members.join(nodes, "print").withColumn("own", level)
    levels = levels.withColumn("level", F.explode(F.array("own", F.col("own") + 1)))
    sums = levels.groupBy("hub", "level").agg(
        F.count("*").alias("sets"), F.sum("n").alias("size"), F.max(F.col("own") == F.col("level")).alias("mine")
    )
    return in_blocks(levels, sums.filter("sets > 1 AND mine"), ["hub", "level"], block_sets, block_members, "own")


def in_blocks(rows: DataFrame, sums: DataFrame, keys: list[str], block_sets: int, block_members: int, *more: str) -> DataFrame:
    """Deal the sets of each key that ``sums`` lists into blocks of bounded number and size, by hash, and send each to all
    pairs (i, j) of its block with another: any two sets of a key meet."""
    blocks = F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("size") / block_members)).cast("int")
    dealt = rows.join(sums.select(*keys, blocks.alias("blocks")), keys)
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*keys, "print", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), *more)


def read_sets(docs: DataFrame, wanted, bits: int, size: int) -> DataFrame:
    """``(doc_id, print, members)`` of documents whose hashed id is flagged (and of a few others by chance)."""

    def work(batches):
        flags, shift = wanted.value, U64(64 - bits)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(flags[W.mix(ids.view(U64)) >> shift]))
            ids = batch.column(0).to_pylist()
            for part in W.slices(W.text_column(batch, "text")):
                sets = list(shingle_sets(part, size))
                yield {
                    "doc_id": ids[part.lo : part.hi],
                    "print": [fingerprint(s) if len(s) else None for s in sets],
                    "members": [s.tobytes() for s in sets],
                }

    return scan(docs, work, "doc_id long, print long, members binary")


def id_flags(ids: DataFrame, bits: int) -> np.ndarray:
    """One flag per hash cell of the (long) ids of a table: a filter of fixed size."""

    def work(batches):
        counters = Counters(bits)
        for batch in batches:
            counters.add(W.mix(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)))
        blocks, cells = counters.rows()
        yield {"block": blocks, "cells": cells}

    return cell_flags(scan(ids, work, "block int, cells binary"), bits, lambda counts: counts > 0)


def compare_maps(cells: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: a forest of the pairs that bit maps leave possible, of each block pair. In a level, one of the two sets
    is of that level (two smaller ones have met in their own)."""

    def work(table):
        maps, sizes, prints = (table.column(c) for c in ("map", "n", "print"))
        own = table.column("own").to_numpy() == table.column("level").to_numpy()
        possible = possible_pairs(maps.to_pylist(), sizes.to_numpy(), percent) & (own[:, None] | own[None, :])
        prints, links = prints.to_pylist(), forest(possible)
        return {"a": [prints[i] for i, _ in links], "b": [prints[j] for _, j in links]}

    return each_run(cells, ["hub", "level", "i", "j"], work, "a long, b long")


def compare_sets(clusters: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that connect the similar sets of each block pair."""

    def work(table):
        pairs = zip(table.column("print").to_pylist(), table.column("members").to_pylist(), strict=True)
        found = {p: np.frombuffer(m, U64) for p, m in pairs}
        prints = sorted(found)
        links = forest(similar_pairs([found[p] for p in prints], percent))
        return {"a": [prints[i] for i, _ in links], "b": [prints[j] for _, j in links]}

    return each_run(clusters, ["cluster", "i", "j"], work, "a long, b long")


def ngram_join(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    rare: int = 32,
    sketch_bits: int = 24,
    block_sets: int = 256,
    block_members: int = 1 << 20,
) -> DataFrame:
    """``(doc_id, n_shingles, print, component_id)`` for every row of ``docs`` (doc_id long, text string).

    Two documents link when their shingle sets have a Jaccard similarity of ``percent`` or more; component_id is the
    smallest doc_id that links reach. Words are runs of anything but ASCII white space, A-Z lower-cased. NULL and
    wordless texts have no set and link with nothing. Rows that repeat a doc_id are documents of their own, each
    with its result; a NULL doc_id is passed over as a component's least id (NULL if it has no other). Other
    columns are ignored. ``rare``: a shingle counts as frequent when its cell in the count sketch (2**sketch_bits
    cells over all documents) exceeds the mean load by six deviations and ``rare``; this sets the cost, not the result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("size levels hold for thresholds of 80 percent or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = saved(read_profile(docs, size, sketch_bits), "profile")
    documents = profile.filter("n IS NOT NULL").select("doc_id", "n", "print")
    nodes = profile.filter("n > 0").groupBy("print").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("map").alias("map")
    )
    load = (documents.agg(F.sum("n")).first()[0] or 0) / (1 << sketch_bits)
    limit = load + 6 * load**0.5 + rare
    sketch = profile.filter("block IS NOT NULL").select("block", "cells")
    flags = spark.sparkContext.broadcast(cell_flags(sketch, sketch_bits, lambda counts: counts > limit))
    entries = read_signatures(docs, size, percent, flags, sketch_bits, parts(spark, 4))
    met = saved(meet(entries), "met")
    cells = cells_of(met, nodes.select("print", "n"), block_sets, block_members)
    possible = compare_maps(cells.join(nodes.select("print", "n", "map"), "print"), percent)
    clusters = components(possible, "a", "b").selectExpr("node AS print", "root AS cluster")
    clusters = saved(clusters.join(nodes, "print").select("print", "cluster", F.col("least").alias("doc_id"), "n"), "clusters")
    filters = spark.sparkContext.broadcast(id_flags(clusters.select("doc_id"), sketch_bits))
    sets = read_sets(docs, filters, sketch_bits, size).withColumnRenamed("doc_id", "of")
    wanted = clusters.withColumnRenamed("print", "own")
    same = (F.col("own") == F.col("print")) & F.col("of").eqNullSafe(F.col("doc_id"))
    sets = sets.join(wanted, same).select("print", "cluster", "members", "n")
    sums = clusters.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    links = compare_sets(in_blocks(sets, sums, ["cluster"], block_sets, block_members, "members"), percent)
    roots = components(links, "a", "b")
    grouped = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "print"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(least, "root").select("print", "component_id")
    out = documents.join(labels, "print", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "print",
    )


def one_of_each_group(docs: DataFrame, sketch_bits: int = 24, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, but of every group of linked documents only the one of least doc_id (a NULL id
    before all, the first written row on ties). Documents without words all stay. ``settings`` as in ``ngram_join``."""
    spark, own = docs.sparkSession, "row of the document"
    rows = saved(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col(own).alias("doc_id"), "text")
    groups = ngram_join(keyed, sketch_bits=sketch_bits, **settings).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("id"))
    groups = saved(groups.join(ids, "row"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("component_id", "first.row")
    gone = saved(groups.join(first, ["component_id", "row"], "left_anti").select("row"), "gone")
    # Rows that are not flagged stay for certain and are not shuffled; the few others meet the list of what goes.
    flags = spark.sparkContext.broadcast(id_flags(gone, sketch_bits))

    def chosen(flagged):
        def work(batches):
            marks, shift = flags.value, U64(64 - sketch_bits)
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(own)).to_numpy()
                yield batch.filter(pa.array(marks[W.mix(ids.view(U64)) >> shift] == flagged))

        return rows.mapInArrow(work, rows.schema)

    left = chosen(True).join(gone, F.col(own) == gone["row"], "left_anti")
    return chosen(False).union(left).drop(own)
