"""Quality rules with cross-document line frequency.

Per text: word, symbol, repetition counts and a base rule. Across texts: normalised lines (A-Z lower-cased, white space
collapsed) are hashed, distinct documents are counted per host and line, lines above the host's limit count as
removed, and documents that keep too little of themselves are rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import saved, scan

U64 = np.uint64
SYMBOL = W.table_of(lambda b: b in b"#*$%&|<>")
CODES = W.byte_codes(fold=False)
FOLDED = W.byte_codes(fold=True)


def repeated_words(grams: np.ndarray, count: int, size: int) -> int:
    """Words of a text of ``count`` words inside windows (their hashes in order) that occur more than once."""
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, np.flatnonzero(twice), 1)
    np.add.at(steps, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def features(part: W.Slice, size: int):
    """Counts of each text, and hash and words of each distinct normalised line that has a word."""
    data, offsets = part.data, part.offsets
    words = W.find_words(part)
    hashes = W.word_hashes(part, words, CODES)
    grams = W.gram_hashes(hashes, size)
    # Bytes that begin a code point, inside words; running sums give counts per text.
    heads = (data & 0xC0) != 0x80
    inside = np.r_[0, np.cumsum(heads & W.NOT_SPACE[data])]
    symbols = np.r_[0, np.cumsum(SYMBOL[data])]
    raw = W.prefix_sums(CODES[data])
    normal = W.prefix_sums(W.word_hashes(part, words, FOLDED))
    breaks = np.flatnonzero(data == 10)
    for k in range(part.hi - part.lo):
        a, b = int(offsets[k]), int(offsets[k + 1])
        lo, hi = int(words.first[k]), int(words.first[k + 1])
        own = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        starts, ends = np.r_[a, own + 1], np.r_[own, b]
        first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        full = last > first
        exact = W.run_hashes(raw, starts[full], ends[full]) + (ends - starts)[full].astype(U64)
        lines = W.run_hashes(normal, first[full], last[full]) + (last - first)[full].astype(U64)
        distinct, inverse = np.unique(lines, return_inverse=True)
        yield {
            "n_words": hi - lo,
            "word_chars": int(inside[b] - inside[a]),
            "n_symbols": int(symbols[b] - symbols[a]),
            "n_dup_lines": len(exact) - len(np.unique(exact)),
            "n_repeat_words": repeated_words(grams[lo : max(lo, hi - size + 1)], hi - lo, size),
            "lines": distinct.view(np.int64),
            "line_words": np.bincount(inverse, (last - first)[full], len(distinct)).astype(np.int64),
        }


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(
    docs: DataFrame,
    host: str = "source",
    size: int = 5,
    least_words: int = 10,
    most_repeat_percent: int = 20,
    line_documents: int = 100,
    line_percent: int = 1,
    least_kept_percent: int = 50,
) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``n_line_words`` (words in lines above the limit) and ``kept``, for every
    row of ``docs`` (doc_id, text and the host column).

    Words are runs of anything but ASCII white space. A line is removed where more than ``line_documents`` documents of its
    host, and more than ``line_percent`` percent of them, have it. A document is kept if it passes the base rule and at least
    ``least_kept_percent`` percent of its words stay. NULL texts have no words and fail; a NULL host is a host of its
    own; repeated rows count as documents. Other columns are ignored.
    """

    def work(batches):
        for batch in batches:
            ids, hosts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in W.slices(W.text_column(batch, "text")):
                rows = list(features(part, size))
                out = {c: [r[c] for r in rows] for c in (*NUMBERS, "lines", "line_words")}
                yield out | {"doc_id": ids[part.lo : part.hi], "host": hosts[part.lo : part.hi]}

    columns = ", ".join(f"{c} long" for c in NUMBERS)
    docs = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    found = scan(docs, work, f"doc_id long, host string, {columns}, lines array<long>, line_words array<long>")
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "features")
    lines = found.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("at"))
    lines = lines.select("row", "host", F.col("at.lines").alias("line"), F.col("at.line_words").alias("words"))
    hosts = found.groupBy("host").agg(F.count("*").alias("documents"))
    limit = F.greatest(F.lit(line_documents), F.floor(F.col("documents") * line_percent / 100))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > line_documents)
    same = counts["host"].eqNullSafe(hosts["host"])
    frequent = counts.join(hosts, same).filter(F.col("n") > limit).select(counts["host"].alias("of"), F.col("line").alias("common"))
    hit = lines.join(frequent, (lines["line"] == F.col("common")) & lines["host"].eqNullSafe(F.col("of")))
    removed = hit.groupBy("row").agg(F.sum("words").alias("n_line_words"))
    out = found.drop("lines", "line_words").join(removed, "row", "left")
    out = out.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    stays = 100 * (F.col("n_words") - F.col("n_line_words")) >= least_kept_percent * F.col("n_words")
    return out.select("doc_id", *NUMBERS, failed.alias("base_failed"), (~failed & stays).alias("kept"), "n_line_words")
