"""Benchmark decontamination: one Aho-Corasick automaton over windows of the normalised benchmark, each text scanned once.

Normalised: A-Z lower-cased, words are runs of digits, a-z and non-ASCII characters, joined by one space. Each item gives
its windows of ``size`` consecutive words (all its words if it has fewer). Matches in the normalised text are mapped back
to byte offsets of the original.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import scan

#: Byte map of the normal form: letters to lower case, all that belongs to no word to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if W.LETTERS[b] else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def line_of(words: list[bytes]) -> str:
    """One character per byte, so that places in it are byte counts."""
    return f" {b' '.join(words).decode('latin-1')} "


def windows(texts: list[tuple[str, str]], size: int) -> dict[str, tuple[int, set[str]]]:
    """Pattern -> (its number of words, ids of the items it comes from)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in texts:
        words = normal_words(text.encode())
        for start in range(max(1, len(words) - size + 1) if words else 0):
            part = words[start : start + size]
            found.setdefault(line_of(part), (len(part), set()))[1].add(item)
    return found


def automaton_of(patterns: dict[str, tuple[int, set[str]]]):
    automaton = ahocorasick.Automaton()
    for pattern, (count, items) in patterns.items():
        automaton.add_word(pattern, (len(pattern), count, items))
    automaton.make_automaton()
    return automaton


GROUP_BYTES = 1 << 26  # of several blocks of patterns each is built once for so many bytes of rows


def grouped(batches, blocks):
    """Batches as they come for a single block of patterns, else gathered into larger ones."""
    held, size = [], 0
    for batch in batches:
        if len(blocks) == 1:
            yield batch
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Scanner:
    """The automata of a task. One block of patterns (the usual case) is built once; of several, one is held at a time."""

    def __init__(self, blocks, size: int):
        self.blocks, self.size = blocks, size
        self.built: tuple[int, object] | None = None

    def automaton(self, k: int):
        if self.built is None or self.built[0] != k:
            patterns = windows(self.blocks[k].value, self.size)
            self.built = (k, automaton_of(patterns) if patterns else None)
        return self.built[1]

    def hits(self, texts: list[bytes]) -> list[tuple[np.ndarray, set[str], int]]:
        """For each text a mark per word, the items met and the number of words."""
        out: list = [None] * len(texts)
        for k in range(len(self.blocks)):
            automaton = self.automaton(k)
            for i, text in enumerate(texts):
                words = normal_words(text)
                marks, items, _ = out[i] or (None, set(), 0)
                spaces = None
                line = line_of(words)
                for end, (length, count, of) in automaton.iter(line) if automaton else ():
                    if spaces is None:
                        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                        marks = np.zeros(len(words), bool) if marks is None else marks
                    first = int(np.searchsorted(spaces, end - length + 1))
                    marks[first : first + count] = True
                    items |= of
                out[i] = (marks, items, len(words))
        return out


def spans_of(text: bytes, marks: np.ndarray) -> list[dict]:
    """Byte spans of the original text under runs of marked words."""
    found = W.find_words(W.Slice(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)])), W.LETTERS)
    edges = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return [{"start": int(found.starts[a]), "end": int(found.ends[b - 1])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def pattern_blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of (item id, text) lists of at most about ``block_bytes`` of text each.

    The size is summed first. A benchmark beyond the bound is dealt out by hash, one block at a time, so neither
    the driver nor an automaton ever holds more than a block (a single longer item is a block of its own)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    key = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    blocks = (items.filter(key == k) if count > 1 else items for k in range(count))
    return [spark.sparkContext.broadcast([(r["item"], r["text"]) for r in block.collect()]) for block in blocks]


RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<start: long, end: long>>"
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 1 << 19) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what it shares with ``benchmark`` (item_id, text); see ``RESULT``.

    A word inside any occurrence of a window is hit; spans are byte offsets of hit runs in the original text. NULL texts
    have no words, items without text or words no windows; windows of an item without id hit like any other, it is only not listed; repeated rows each get their result. Item ids are
    sorted as strings. Other columns are ignored. An empty benchmark leaves every document clean.
    """
    blocks = pattern_blocks(benchmark, block_bytes)

    def work(batches):
        scanner = Scanner(blocks, size)
        for batch in grouped(batches, blocks):
            ids = batch.column(0).to_pylist()
            texts = W.text_column(batch, "text").cast(pa.large_binary()).to_pylist()
            hits = scanner.hits(texts)
            none = np.zeros(0, bool)
            items = [sorted(found - {None}) for _, found, _ in hits]
            yield {
                "doc_id": ids,
                "n_words": [n for _, _, n in hits],
                "n_hit": [0 if m is None else int(m.sum()) for m, _, _ in hits],
                "n_items": [len(found) for found in items],
                "items_sha256": [hashlib.sha256(",".join(found).encode()).hexdigest() for found in items],
                "contaminated": [m is not None for m, _, _ in hits],
                "spans": [spans_of(t, none if m is None else m) if m is not None else [] for t, (m, _, _) in zip(texts, hits, strict=True)],
            }

    return scan(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 1 << 19) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark window."""
    blocks = pattern_blocks(benchmark, block_bytes)

    def work(batches):
        scanner = Scanner(blocks, size)
        for batch in grouped(batches, blocks):
            texts = W.text_column(batch, "text").cast(pa.large_binary()).to_pylist()
            yield batch.filter(pa.array([m is None for m, _, _ in scanner.hits(texts)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
