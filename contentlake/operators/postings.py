"""Trigrams of file names as blocks: a term with the places where it stands in a stretch of files.

A file name has about as many trigrams as letters, so the list of all of them is far longer than the files. Cut in Arrow batches of
files, a term's places in a batch become a few rows of three arrays; only these are moved and sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
BLOCK = 256  # places in a row, at most
LETTERS = 1 << 20  # letters cut at a time, unless one batch holds more
SCHEMA = "term string, item_id long, last_id long, item_ids array<long>, file_indexes array<long>, places array<int>"


def cut(files: pa.Table) -> pa.RecordBatch | None:
    """Blocks of the trigrams of ``name``; ``item_id`` must not be null."""
    names = files["name"].combine_chunks()
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    grams = np.maximum(lengths - GRAM + 1, 0)
    total = int(grams.sum())
    if not total:
        return None
    owner = np.repeat(np.arange(len(grams)), grams)
    place = np.arange(total) - np.repeat(np.cumsum(grams) - grams, grams)
    start = np.repeat(np.cumsum(lengths) - lengths, grams) + place
    seen = np.zeros(0x110000, dtype=bool)
    seen[letters] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    letters, bits, own = number[letters], max(len(alphabet) - 1, 1).bit_length(), (total - 1).bit_length()
    code = letters[start]
    for k in range(1, GRAM):
        code = code << bits | letters[start + k]
    if GRAM * bits + own < 64:  # sorted as plain numbers, with the place in the batch below the term
        code = np.sort(code << own | np.arange(total))
        order, code = code & ((1 << own) - 1), code >> own
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    within = np.arange(total) - np.repeat(new, np.diff(np.append(new, total)))
    first = np.flatnonzero(within % BLOCK == 0)
    ends = pa.array(np.append(first, total).astype(np.int32))
    mask = (1 << bits) - 1
    text = alphabet[np.stack([code[first] >> bits * (GRAM - 1 - k) & mask for k in range(GRAM)], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    rows = pa.array(owner[order])
    ids = files["item_id"].combine_chunks().take(rows)
    plain = ids.to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([text[k : k + GRAM] for k in range(0, len(text), GRAM)], pa.string()),
            pa.array(np.minimum.reduceat(plain, first)), pa.array(np.maximum.reduceat(plain, first)),
            pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, files["file_index"].combine_chunks().take(rows)),
            pa.ListArray.from_arrays(ends, pa.array((place[order] + 1).astype(np.int32))),
        ],
        names=["term", "item_id", "last_id", "item_ids", "file_indexes", "places"],
    )


def gram_blocks(files: DataFrame) -> DataFrame:
    """(term, item_id, last_id, item_ids, file_indexes, places) of files(item_id, file_index, name): a block's lowest and highest
    item and its places, counted from 1. Names are cut as they are; files of no item or without a name have no places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("name").nbytes
            if size >= LETTERS:
                yield from filter(None, [cut(pa.Table.from_batches(held))])
                held, size = [], 0
        if held:
            yield from filter(None, [cut(pa.Table.from_batches(held))])

    files = files.select("item_id", F.col("file_index").cast("long").alias("file_index"), "name")
    return files.filter("item_id IS NOT NULL AND name IS NOT NULL").mapInArrow(run, SCHEMA)


def unfolded(blocks: DataFrame, *more: str) -> DataFrame:
    """(term, item_id, file_index, place) and the columns ``more`` of every place of some blocks."""
    rows = blocks.select("term", *more, F.explode(F.arrays_zip("item_ids", "file_indexes", "places")).alias("at"))
    return rows.select("term", F.col("at.item_ids").alias("item_id"), F.col("at.file_indexes").alias("file_index"), F.col("at.places").alias("place"), *more)
