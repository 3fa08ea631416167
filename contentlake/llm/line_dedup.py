"""Line dedup by a log-template tree of fixed depth.

A line's first step down the tree is its number of words, the next ones its leading words, with words that hold a digit
generalised to ``<*>``. In a leaf the remaining places are generalised by how often their words recur there: at several levels,
from words that most lines of the leaf share down to words that recur at all, a word below the level gives way to the word that is
most frequent in its place behind the same word, else in its place, or to ``<*>`` where none reaches the level. What is left is a template of the line; a line is its
instance if enough of the template's words are its own. So a leaf holds as many templates as its lines have, a field with a
few frequent values is generalised at one level and its values kept apart at the next, and all of it follows from one count of
(leaf, place, word). Templates whose instances recur in enough documents are dropped from all of them, as are masked
lines that recur as they are.

The leading words, equal in the whole leaf, count in the agreement but make no template; a line with no more words past them
than they are goes only where its whole masked form recurs. Only lines of leaves that recur are ever looked at: a count of
documents per leaf comes first. From there on, equal lines are one row with a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import Counters, cell_flags, saved, scan

U64 = np.uint64
CODES = W.byte_codes(fold=False)
DIGIT = W.table_of(lambda b: 48 <= b <= 57)
WILD = "<*>"


def masked(word: str) -> str:
    return WILD if any("0" <= c <= "9" for c in word) else word


def read_lines(part: W.Slice, depth: int):
    """Of every line with a word: text number, byte span, hash of its leaf and hash of its masked words."""
    data, offsets = part.data, part.offsets
    words = W.find_words(part)
    hashes = W.word_hashes(part, words, CODES)
    digits = np.r_[0, np.cumsum(DIGIT[data])]
    wild = W.word_hashes(W.Slice(0, 1, np.frombuffer(WILD.encode(), np.uint8), None), W.Words(np.array([0]), np.array([3]), None), CODES)
    hashes = np.where(digits[words.ends] > digits[words.starts], wild[0], hashes)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.r_[starts[1:], len(data)], offsets[text + 1])
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = last > first
    starts, ends, text, first, last = (x[full] for x in (starts, ends, text, first, last))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))
    sums = W.prefix_sums(hashes)
    count = (last - first).astype(U64)
    leaf = W.mix(W.run_hashes(sums, first, np.minimum(last, first + depth)) ^ W.mix(count))
    line = W.mix(W.run_hashes(sums, first, last) + count)
    return text, starts, ends, leaf, line


def tags_of(part: W.Slice) -> np.ndarray:
    return W.run_hashes(W.prefix_sums(CODES[part.data]), part.offsets[:-1], part.offsets[1:]).view(np.int64)


def leaves_of(docs: DataFrame, depth: int) -> DataFrame:
    """``(id, tag, leaf, line)``: distinct lines of every document, by hash."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in W.slices(W.text_column(batch, "text")):
                text, _, _, leaf, line = read_lines(part, depth)
                order = np.lexsort((line, leaf, text))
                text, leaf, line = text[order], leaf[order], line[order]
                new = np.r_[True, (np.diff(text) != 0) | (np.diff(leaf.view(np.int64)) != 0) | (np.diff(line.view(np.int64)) != 0)][: len(text)]
                text, leaf, line = text[new], leaf[new], line[new]
                tags = tags_of(part)
                yield {"id": ids[part.lo : part.hi][text], "tag": tags[text], "leaf": leaf.view(np.int64), "line": line.view(np.int64)}

    return scan(docs, work, "id long, tag long, leaf long, line long")


def leaf_flags(leaves: DataFrame, bits: int) -> np.ndarray:
    """One flag per hash cell of recurring leaves, a filter of fixed size."""

    def work(batches):
        counters = Counters(bits)
        for batch in batches:
            counters.add(batch.column(0).to_numpy().view(U64))
        blocks, cells = counters.rows()
        yield {"block": blocks, "cells": cells}

    return cell_flags(scan(leaves, work, "block int, cells binary"), bits, lambda counts: counts > 0)


def line_words(docs: DataFrame, flags, bits: int, depth: int) -> DataFrame:
    """``(leaf, line, words)``: masked words of lines in flagged leaves, each line once per batch."""

    def work(batches):
        marks, shift = flags.value, U64(64 - bits)
        for batch in batches:
            found: dict[tuple[int, int], list[str]] = {}
            for part in W.slices(W.text_column(batch, "text")):
                _, starts, ends, leaf, line = read_lines(part, depth)
                held = np.flatnonzero(marks[leaf >> shift])
                keys = zip(leaf[held].view(np.int64).tolist(), line[held].view(np.int64).tolist(), held.tolist(), strict=True)
                for a, b, k in keys:
                    if (a, b) not in found:
                        raw = part.data[starts[k] : ends[k]].tobytes().split()
                        found[a, b] = [masked(w.decode()) for w in raw]
            yield {"leaf": [a for a, _ in found], "line": [b for _, b in found], "words": list(found.values())}

    return scan(docs, work, "leaf long, line long, words array<string>")


LEVELS = (2, 8, 32)  # a word stays if more than this part of a leaf's lines have it in its place, and at a last level if it recurs


def templates_of(lines: DataFrame, depth: int, least_votes: int, agree_percent: int, fixed_percent: int) -> DataFrame:
    """``(leaf, line, n, template)``: the templates that a line is an instance of, at most one for each level.

    Words and their counts meet their lines by place; a line comes back together from as many rows as it has words."""
    lines = lines.filter(F.size("words") > 2 * depth)
    lead = F.size(F.filter(F.slice("words", 1, depth), lambda w: w != WILD))
    totals = lines.groupBy("leaf").agg(F.sum("n").alias("total"))
    places = lines.select("leaf", "line", "n", "words", F.posexplode("words").alias("place", "word"))
    places = places.filter((F.col("place") >= depth) & (F.col("word") != WILD))
    places = places.select("leaf", "line", "n", "place", "word", F.get("words", F.col("place") - 1).alias("behind"))
    pairs = places.groupBy("leaf", "place", "word", "behind").agg(F.sum("n").alias("votes"))
    votes = pairs.groupBy("leaf", "place", "word").agg(F.sum("votes").alias("votes")).filter(F.col("votes") >= least_votes)
    votes = saved(votes, "votes")
    pairs = saved(pairs.filter(F.col("votes") >= least_votes), "votes")
    best = F.max(F.struct("votes", "word"))
    tops, nexts = votes.groupBy("leaf", "place").agg(best.alias("top")), pairs.groupBy("leaf", "place", "behind").agg(best.alias("next"))
    cells = places.drop("n").join(votes, ["leaf", "place", "word"], "left").join(tops, ["leaf", "place"])
    cells = cells.join(nexts, ["leaf", "place", "behind"], "left")
    cell = F.struct("place", "word", F.coalesce("votes", F.lit(0)).alias("votes"), "top", "next")
    cells = cells.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = lines.select("leaf", "line", "n", lead.alias("lead"), (F.size("words") - depth).alias("size"))
    rows = rows.join(cells, ["leaf", "line"]).join(totals, "leaf")
    least = F.array(*[F.greatest(F.lit(least_votes), F.floor(F.col("total") / part) + 1) for part in LEVELS], F.lit(least_votes).cast("long"))
    rows = rows.withColumn("least", F.explode(F.array_distinct(least)))
    own = F.filter("cells", lambda c: c["votes"] >= F.col("least"))
    kept = F.filter("cells", lambda c: c["top"]["votes"] >= F.col("least"))

    def chosen(c):
        held = F.when(c["votes"] >= F.col("least"), c["word"]).when(c["next"]["votes"] >= F.col("least"), c["next"]["word"])
        return F.struct(c["place"], held.otherwise(c["top"]["word"]))

    word = F.transform(kept, chosen)
    rows = rows.select("leaf", "line", "n", "lead", "size", F.size(own).alias("own"), word.alias("fixed"))
    rows = rows.filter((F.col("own") > 0) & (100 * F.size("fixed") >= fixed_percent * F.col("size")))
    rows = rows.filter(100 * (F.col("own") + F.col("lead")) >= agree_percent * (F.size("fixed") + F.col("lead")))
    return rows.select("leaf", "line", "n", F.xxhash64("leaf", "fixed").alias("template")).distinct()


def recurring_templates(instances: DataFrame, leaves: DataFrame, least_documents: int) -> DataFrame:
    """``(leaf, template)``. One line with enough documents settles a template; of the others, those that can reach them are
    counted."""
    sums = instances.groupBy("leaf", "template").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    sums = saved(sums.filter(F.col("total") >= least_documents), "sums")
    near = instances.join(sums.filter(F.col("most") < least_documents), ["leaf", "template"], "left_semi")
    spread = leaves.join(near, ["leaf", "line"]).select("id", "tag", "leaf", "template").distinct()
    spread = spread.groupBy("leaf", "template").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least_documents)
    return saved(sums.filter(F.col("most") >= least_documents).select("leaf", "template").union(spread.select("leaf", "template")), "kept")


def dropped_lines(leaves: DataFrame, docs: DataFrame, depth: int, least_documents: int, agree_percent: int, fixed_percent: int, bits: int) -> DataFrame:
    """``(leaf, line)`` of the instances of recurring templates."""
    recurring = leaves.select("id", "tag", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("documents"))
    recurring = saved(recurring.filter(F.col("documents") >= least_documents).select("leaf"), "leaves")
    flags = docs.sparkSession.sparkContext.broadcast(leaf_flags(recurring, bits))
    lines = line_words(docs, flags, bits, depth).groupBy("leaf", "line").agg(F.first("words").alias("words"))
    counts = leaves.join(recurring, "leaf", "left_semi").distinct().groupBy("leaf", "line").agg(F.count("*").alias("n"))
    lines = saved(lines.join(counts, ["leaf", "line"]), "lines")
    # Lines that recur as they are, but for masked words, go whatever else their leaf holds.
    plain = F.size(F.filter("words", lambda w: w != WILD))
    own = lines.filter((F.col("n") >= least_documents) & (100 * plain >= fixed_percent * F.size("words"))).select("leaf", "line")
    least_votes = max(1, -(-agree_percent * least_documents // 100))
    met = saved(templates_of(lines, depth, least_votes, agree_percent, fixed_percent), "instances")
    kept = recurring_templates(met, leaves, least_documents)
    return met.join(kept, ["leaf", "template"], "left_semi").select("leaf", "line").union(own).distinct()


RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def line_dedup(
    docs: DataFrame, depth: int = 3, least_documents: int = 20, agree_percent: int = 80, fixed_percent: int = 50, flag_bits: int = 24
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text, kept_sha256`` for every row of ``docs`` (doc_id, text).

    Lines are split at \\n; those without a word (a run of anything but ASCII white space) always stay. A template needs
    ``fixed_percent`` percent fixed places past the first ``depth`` words, of these and the leading words ``agree_percent`` percent are an
    instance's own, and it takes ``least_documents`` documents to drop one: fewer say little about a template, since near copies of one
    document come in such numbers too. Of lines whose masked form recurs as it is, ``fixed_percent`` percent of all words must be unmasked. A document is its (doc_id, text): repeated rows count once and each get the
    result. A NULL text is empty and keeps the empty text. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    leaves = saved(leaves_of(keyed.select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "text"), depth), "lines")
    dropped = saved(dropped_lines(leaves, keyed, depth, least_documents, agree_percent, fixed_percent, flag_bits), "dropped")
    hit = leaves.join(dropped, ["leaf", "line"]).groupBy("id", "tag").agg(F.collect_set("line").alias("lines"))

    def tagged(batches):
        for batch in batches:
            tags = np.concatenate([tags_of(p) for p in W.slices(W.text_column(batch, "text"))] or [np.zeros(0, np.int64)])
            yield {"doc_id": batch.column(0), "tag": tags, "text": batch.column(1)}

    rows = scan(keyed, tagged, "doc_id long, tag long, text string")
    own = F.coalesce(rows["doc_id"], F.lit((1 << 63) - 1))
    rows = rows.join(hit, (own == hit["id"]) & (rows["tag"] == hit["tag"]), "left").select("doc_id", "text", "lines")

    def cut(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for part in W.slices(W.text_column(batch, "text")):
                text, starts, ends, _, line = read_lines(part, depth)
                begin = np.searchsorted(text, np.arange(part.hi - part.lo + 1))
                for k in range(part.hi - part.lo):
                    a, b = int(part.offsets[k]), int(part.offsets[k + 1])
                    raw = part.data[a:b].tobytes()
                    lines, drop = raw.split(b"\n"), set()
                    if marks[part.lo + k]:
                        own = slice(int(begin[k]), int(begin[k + 1]))
                        gone = np.isin(line[own].view(np.int64), np.array(marks[part.lo + k]))
                        drop = set((starts[own][gone] - a).tolist())
                    kept, at = [], 0
                    for one in lines:
                        if at not in drop:
                            kept.append(one)
                        at += len(one) + 1
                    left = b"\n".join(kept)
                    out.append((ids[part.lo + k], len(lines), len(lines) - len(kept), left.decode(), hashlib.sha256(left).hexdigest()))
            names = ("doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256")
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

    return scan(rows, cut, RESULT)
