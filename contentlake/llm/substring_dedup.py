"""Substring dedup: repeated word windows by super-k-mer partitioning, the first occurrence stays.

Consecutive windows that share a minimiser travel as one packed string to its bucket (see ``repeats``); there words become
exact numbers, and windows are ranked by sorting pairs of ranks of doubling length, so equal ranks are equal windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from contentlake.llm.repeats import WordUnits, remove_repeats

U64 = np.uint64


def ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` consecutive ids (at least one): equal numbers, equal runs."""
    _, rank = np.unique(ids, return_inverse=True)
    size = 1
    while size < length:
        step = min(size, length - size)
        pairs = rank[:-step].astype(U64) << U64(32) | rank[step:].astype(U64)
        _, rank = np.unique(pairs, return_inverse=True)
        size += step
    return rank


def later_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Marks of the windows of each string (words joined by spaces, in order of place) that an earlier one equals."""
    numbers: dict[bytes, int] = {}
    ids, counts = [], []
    for text in strings:
        words = text.split(b" ")
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        counts.append(len(words))
    offsets = np.r_[0, np.cumsum(counts)]
    if len(ids) < length:
        return [np.zeros(0, bool) for _ in strings]
    rank = ranks(np.array(ids, np.int64), length)
    inside = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    _, first, inverse = np.unique(rank[inside], return_index=True, return_inverse=True)
    later = first[inverse] != np.arange(len(inside))
    cuts = np.cumsum([max(0, c - length + 1) for c in counts])[:-1]
    return np.split(later, cuts)


def substring_dedup(
    docs: DataFrame, length: int = 20, gram: int = 6, most: int = 4096, chunk: int = 1 << 21, flag_bits: int = 24
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the words under windows of ``length`` words that also start earlier (smaller
    doc_id, or same document, earlier start), as ``remove_repeats`` returns them; spans count words.

    Words are runs of anything but ASCII white space, unchanged. NULL texts have none; ties and repeated rows as told in
    ``repeats``; other columns are ignored. ``gram``: words of a minimiser. ``most``, ``chunk`` and ``flag_bits`` set
    memory, not results.
    """
    return remove_repeats(docs, WordUnits, length, gram, later_windows, True, most, chunk, flag_bits)
