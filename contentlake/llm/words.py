"""Words of many texts at once: offsets and 64-bit hashes over Arrow buffers, without a Python string per word.

A text column arrives as one byte buffer with offsets. A hash of any byte run is a difference of running sums
of ``code[byte] * BASE ** position`` (modulo 2**64), brought back to position 0 and mixed; runs of word hashes are
hashed in the same way. Texts are never cut: a slice holds whole texts, a long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8, so powers differ in all but their lowest bits
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (the public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, log_size: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U64), np.cumprod(np.full((1 << log_size) - 1, base, U64), dtype=U64)])


def powers(n: int, base: int = BASE) -> np.ndarray:
    return _powers(base, max(12, int(n - 1).bit_length() if n > 1 else 0))[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of codes[i] * BASE ** i, with a leading 0."""
    out = np.empty(len(codes) + 1, U64)
    out[0] = 0
    np.cumsum(codes * powers(len(codes)), dtype=U64, out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of codes[start:end] for each pair."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts])


def byte_codes(fold: bool) -> np.ndarray:
    """A random 64-bit code per byte; with ``fold`` A-Z get the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def table_of(inside) -> np.ndarray:
    """Which bytes belong to words."""
    return np.array([bool(inside(b)) for b in range(256)])


NOT_SPACE = table_of(lambda b: b != 32 and not 9 <= b <= 13)
LETTERS = table_of(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


class Slice(NamedTuple):
    """Rows lo..hi of a batch: their bytes, and offsets of each text (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings, NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole texts in slices of about ``size`` bytes."""
    rows = len(texts)
    if rows == 0:
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(rows, max(hi, lo + 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        yield Slice(lo, hi, data[a:b], offsets[lo : hi + 1] - a)
        lo = hi


class Words(NamedTuple):
    """Byte offsets of words, and for each text the place of its first word (one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(part: Slice, inside: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = part.data, part.offsets
    is_word = inside[data]
    begin, end = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    heads, tails = offsets[:-1], offsets[1:] - 1
    heads, tails = heads[heads < len(data)], tails[tails >= 0]
    begin[heads] |= is_word[heads]
    end[tails] |= is_word[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(part: Slice, words: Words, codes: np.ndarray) -> np.ndarray:
    return run_hashes(prefix_sums(codes[part.data]), words.starts, words.ends)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (runs over text borders are the caller's to drop)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for k, factor in enumerate(powers(size)):
        total += hashes[k : k + count] * factor
    return mix(total)
