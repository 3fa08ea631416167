"""Suffix-array dedup: longest-previous-factor arrays over the texts that share a minimiser.

Strings that may hold a common run of ``length`` bytes meet in a bucket (see ``repeats``). There the window starts are sorted in
suffix order to that depth by prefix doubling. Previous and next smaller positions in suffix order give, with the least common
prefix on the way, the longest match of each position with an earlier one: the longest previous factor. The same with larger
positions gives the longest later match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from contentlake.llm.repeats import ByteUnits, remove_repeats

U64 = np.uint64


def dense(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """Ranks of keys below 2**bits: equal keys get equal ranks, in order."""
    place_bits = int(len(keys)).bit_length()
    if bits + place_bits <= 64:  # the place rides along in the low bits: a sort of values is faster than one of places
        both = np.sort(keys << U64(place_bits) | np.arange(len(keys), dtype=U64))
        order, ordered = (both & U64((1 << place_bits) - 1)).astype(np.int64), both >> U64(place_bits)
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return rank


def doubling(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of the ``size`` bytes at each place) for sizes 8, 16, ... below or at ``depth``; past the end are zero bytes."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    key = np.zeros(len(data), U64)
    for k in range(8):
        key = key << U64(8) | padded[k : k + len(data)]
    levels, size = [(8, dense(key))], 8
    while size * 2 <= depth:
        rank = levels[-1][1]
        ahead = np.zeros(len(rank), np.int32)
        ahead[: max(0, len(rank) - size)] = rank[size:] + 1
        half = int(len(rank)).bit_length()
        levels.append((size * 2, dense(rank.astype(U64) << U64(half) | ahead.astype(U64), 2 * half)))
        size *= 2
    return levels


def matches(order: np.ndarray, common: np.ndarray, smaller: bool) -> np.ndarray:
    """Longest match of each place of ``order`` (places in suffix order) with a smaller (or larger) place; ``common[k]`` is the
    match of neighbours k - 1 and k. Nearest such places on either side are found by following pointers, all at once."""
    count = len(order)
    value = order if smaller else -order
    best = np.zeros(count, np.int64)
    for turned in (False, True):
        v = value[::-1] if turned else value
        link = np.r_[0, common[1:][::-1]] if turned else common.copy()
        point = np.arange(count) - 1
        shared = link.copy()
        open_ = np.flatnonzero(point >= 0)
        while len(open_):
            open_ = open_[v[point[open_]] > v[open_]]
            at = point[open_]
            shared[open_] = np.minimum(shared[open_], shared[at])
            point[open_] = point[at]
            open_ = open_[point[open_] >= 0]
        shared[point < 0] = 0
        best = np.maximum(best, shared[::-1] if turned else shared)
    return best


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest later factor of each of ``starts`` (ascending) among them: whole steps of 8 bytes, up to
    ``length``, which is exact."""
    if length < 8:
        raise ValueError("suffixes are ranked from 8 bytes on")
    levels = doubling(data, length)
    size, rank = levels[-1]
    rest = length - size
    key = rank[starts].astype(U64) << U64(32) | rank[np.minimum(starts + rest, len(data) - 1)].astype(U64)
    order = starts[np.argsort(key, kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    # Neighbours: the widest equal step again and again; the last, overlapping step settles what is left.
    same = np.zeros(len(a), np.int64)
    for width, level in [levels[-1], *levels[::-1]]:
        i, j = np.minimum(a + same, len(data) - 1), np.minimum(b + same, len(data) - 1)
        same += np.where((level[i] == level[j]) & (same + width <= length), width, 0)
    for width, level in levels:
        back = np.maximum(length - width, 0)
        i, j = np.minimum(a + back, len(data) - 1), np.minimum(b + back, len(data) - 1)
        same = np.where((same >= back) & (level[i] == level[j]), length, same)
    common[1:] = same
    previous, later = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    previous[order] = matches(order, common, True)
    later[order] = matches(order, common, False)
    return previous[starts], later[starts]


def repeated_windows(keep_first: bool):
    def solver(strings: list[bytes], length: int) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum([len(s) for s in strings])
        counts = [max(0, len(s) - length + 1) for s in strings]
        begins = ends - [len(s) for s in strings]
        starts = np.concatenate([np.arange(a, a + c) for a, c in zip(begins, counts, strict=True)]) if strings else begins
        if len(starts) == 0:
            return [np.zeros(0, bool) for _ in strings]
        previous, later = factors(data, starts, length)
        marks = previous >= length if keep_first else np.maximum(previous, later) >= length
        return np.split(marks, np.cumsum(counts)[:-1])

    return solver


def suffix_dedup(
    docs: DataFrame, length: int = 400, keep_first: bool = True, gram: int = 120, most: int = 4096, chunk: int = 1 << 20, flag_bits: int = 24
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the bytes under ``length``-byte strings that also start earlier, or with
    ``keep_first`` false anywhere else, as ``remove_repeats`` returns them; spans count bytes.

    Matches never cross documents; strings are judged on the input, not on what is left. NULL texts are empty; ties and
    repeated rows as told in ``repeats``; other columns are ignored. ``gram``: bytes of a minimiser.
    """
    return remove_repeats(docs, ByteUnits, length, gram, repeated_windows(keep_first), keep_first, most, chunk, flag_bits)
