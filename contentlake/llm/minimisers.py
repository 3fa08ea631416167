"""Minimisers over runs of units (words or bytes), for many texts at once.

A window is ``length`` consecutive units of one text, a gram ``size`` of them. The minimiser of a window is its gram of least
hash, the leftmost on ties. Equal windows have equal minimisers at equal offsets, wherever they are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U64 = np.uint64
PLACE = U64((1 << 28) - 1)  # low bits of a key: the place in a slice; the rest is hash


def sliding_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones, from running minima in blocks of that width."""
    count = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    padded[: len(keys)] = keys
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


class Runs(NamedTuple):
    """Consecutive windows that share a minimiser: first and last window start, place of the minimiser, its hash, text."""

    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    text: np.ndarray


def super_runs(grams: np.ndarray, offsets: np.ndarray, length: int, size: int, stretch: int = int(PLACE)) -> Runs:
    """``grams``: hash of the gram at each place; ``offsets``: place of the first unit of each text (one more than texts).

    More than ``stretch`` places are taken in stretches that overlap by a window less one gram; a run ends where its stretch does.
    """
    width = length - size + 1
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return Runs(none, none, np.zeros(0, U64), none)
    if len(grams) > stretch:
        found = []
        for a in range(0, len(grams) - width + 1, stretch - width + 1):
            part = grams[a : a + stretch]
            runs = super_runs(part, np.clip(offsets - a, 0, len(part) + size - 1), length, size, stretch)
            found.append(Runs(runs.first + a, runs.last + a, runs.hashes, runs.text))
        return Runs(*(np.concatenate(c) for c in zip(*found, strict=True)))
    keys = (grams & ~PLACE) | np.arange(len(grams), dtype=U64)
    least = sliding_minima(keys, width)
    whole = np.zeros(len(least) + 1, np.int8)  # window starts inside one text
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(whole, offsets[long], 1)
    np.add.at(whole, offsets[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    if len(starts) == 0:
        return Runs(none, none, np.zeros(0, U64), none)
    places = (least[starts] & PLACE).astype(np.int64)
    cut = np.flatnonzero((np.diff(places) != 0) | (np.diff(starts) != 1))
    first, last = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]
    places = places[np.r_[0, cut + 1]]
    return Runs(first, last, grams[places], np.searchsorted(offsets, first, "right") - 1)
