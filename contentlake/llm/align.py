"""Alignment of two tokenizers' tokens over the same texts, and corpus counts of token pairs.

Both tokenizers read whole texts. Where tokens of both begin with a space at the same byte, a text is cut into windows, most
of them a word long; the bytes are verified first, so a cut is a shared end of both. A window is known by its two tuples of
token ids, and its alignment (groups between shared ends, linked pairs) is worked out once and looked up from then on.

A pair's count is the number of texts that hold it linked. Texts travel in blocks: a block brings each of its distinct pairs to
the counts once, however many of its texts hold it, and gets the counts back, so a frequent pair costs a row per block.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import each_run, saved, scan, squeeze, unsqueeze

FOLDER = "/opt/tokenizers"
BLOCK_BYTES = 1 << 22
MEMO_SIZE = 1 << 22  # ids and pairs that the windows of a task may take before it begins anew
LOW = (1 << 32) - 1


class Vocabulary(NamedTuple):
    """The bytes of every token, their number, and whether they begin with a space."""

    pieces: list[bytes]
    sizes: np.ndarray
    spaced: np.ndarray


def vocabulary(pieces: list[bytes]) -> Vocabulary:
    return Vocabulary(pieces, np.array([len(p) for p in pieces], np.int64), np.array([p[:1] == b" " for p in pieces]))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


# Fixed value: how byte-level files split a text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(encode a list of texts behind a space, vocabulary) of a byte-level tokenizer file; special tokens in texts are plain text.

    A file without normaliser whose merges come in the order of their ids, as is usual, is the ranked form of byte pair
    encoding: it is read as ranks, which encodes the same several times as fast. Any other is left to the library of the format.
    """
    with open(path, encoding="utf-8") as file:
        note = json.load(file)
    special = {t["content"] for t in note["added_tokens"]}
    vocab, letters = note["model"]["vocab"] | {t["content"]: t["id"] for t in note["added_tokens"]}, byte_letters()
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        pieces[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in note["model"]["merges"]]
    before = note["pre_tokenizer"] or {}
    ranked = note["normalizer"] is None and [vocab.get(m) for m in merged] == list(range(256, 256 + len(merged)))
    if ranked and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        import tiktoken

        ranks = {pieces[k]: k for piece, k in vocab.items() if piece not in special}
        encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [encoding.encode_to_numpy(" " + t) for t in texts]), vocabulary(pieces)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return encode, vocabulary(pieces)


@lru_cache(maxsize=2)
def sentence_pieces(path: str):
    """(encode a list of texts, vocabulary) of a sentence-piece model, which puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(k: int) -> bytes:
        text = model.id_to_piece(k)
        return bytes([int(text[3:5], 16)]) if model.is_byte(k) else text.replace("▁", " ").encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(own, np.uint32) for own in model.encode(texts, num_threads=1)]

    return encode, vocabulary([piece(k) for k in range(model.get_piece_size())])


class Tokens(NamedTuple):
    """The tokens of several texts in a row: ids, and the byte at which each begins (and, last, where all end)."""

    ids: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, ids: list[np.ndarray], known: Vocabulary) -> Tokens:
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
        return cls(flat, np.r_[0, np.cumsum(known.sizes[flat])])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Windows:
    """Alignments of the windows met so far, by their two id tuples (as bytes)."""

    LONG = 4096  # pairs of a group beyond which they are counted by distinct ids

    def __init__(self, one: Vocabulary, two: Vocabulary):
        digits = [np.array([f"{k}{end}" for k in range(len(v.pieces))], object) for v, ends in ((one, ",|"), (two, ",;")) for end in ends]
        self.digits = digits
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.shown: list[str] = []  # each group ends with a semicolon
        none = np.zeros(0, np.int64)
        self.groups, self.links, self.first, self.pairs, self.weights = none, none, np.zeros(1, np.int64), none, none
        self.size = 0

    def numbers(self, a: Tokens, b: Tokens, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The number of each window; windows are the tokens between neighbouring places of ``at_a`` and ``at_b``."""
        data_a, data_b, known = a.ids.tobytes(), b.ids.tobytes(), self.known
        from_a, from_b = (at_a * 4).tolist(), (at_b * 4).tolist()
        spans = zip(from_a[:-1], from_a[1:], from_b[:-1], from_b[1:], strict=True)
        found, new = [], []
        for place, (i, j, k, m) in enumerate(spans):
            key = (data_a[i:j], data_b[k:m])
            number = known.get(key)
            if number is None:
                number = known[key] = len(known)
                new.append(place)
            found.append(number)
        if new:
            new = np.array(new)
            self.learn(a, b, at_a[new], at_a[new + 1], at_b[new], at_b[new + 1])
        return np.array(found, np.int64)

    def learn(self, a: Tokens, b: Tokens, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Align new windows, all at once."""
        ends = np.zeros((2, int(a.begin[-1]) + 1), bool)
        ends[0, a.begin], ends[1, b.begin] = True, True
        shared = ends[0] & ends[1]
        place_a, place_b = spread(a0, a1 - a0), spread(b0, b1 - b0)
        ids_a, ids_b = a.ids[place_a].astype(np.int64), b.ids[place_b].astype(np.int64)
        last_a, last_b = shared[a.begin[place_a + 1]], shared[b.begin[place_b + 1]]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        start_a, start_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        # Shown group by group: the tokens of A, then those of B.
        text = np.empty(len(ids_a) + len(ids_b), object)
        place = np.arange(len(ids_a)) + start_b[group_a]
        text[place] = np.where(last_a, self.digits[1][ids_a], self.digits[0][ids_a])
        place = np.arange(len(ids_b)) + (start_a + many_a)[group_b]
        text[place] = np.where(last_b, self.digits[3][ids_b], self.digits[2][ids_b])
        text, borders = text.tolist(), np.cumsum(np.r_[0, a1 - a0 + b1 - b0]).tolist()
        self.shown += ["".join(text[x:y]) for x, y in zip(borders[:-1], borders[1:], strict=True)]
        window = np.repeat(np.arange(len(a0)), a1 - a0)[last_a]  # of each group
        products = many_a * many_b
        short = products <= self.LONG
        group = np.repeat(np.flatnonzero(short), products[short])
        rank = spread(np.zeros(short.sum(), np.int64), products[short])
        pair = ids_a[start_a[group] + rank // many_b[group]] << 32 | ids_b[start_b[group] + rank % many_b[group]]
        owner, pairs, times = [window[group]], [pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(~short).tolist():
            x, n = np.unique(ids_a[start_a[g] : start_a[g] + many_a[g]], return_counts=True)
            y, m = np.unique(ids_b[start_b[g] : start_b[g] + many_b[g]], return_counts=True)
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((n[:, None] * m).ravel())
            owner.append(np.full(len(pairs[-1]), window[g]))
        owner, pair, times = np.concatenate(owner), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((pair, owner))
        owner, pair, times = owner[order], pair[order], times[order]
        head = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(pair) != 0)])
        self.pairs = np.r_[self.pairs, pair[head]]
        self.weights = np.r_[self.weights, np.add.reduceat(times, head)]
        own = np.cumsum(np.bincount(owner[head], minlength=len(a0)))
        self.first = np.r_[self.first, self.first[-1] + own]
        self.groups = np.r_[self.groups, np.bincount(window, minlength=len(a0))]
        links = np.zeros(len(a0), np.int64)
        np.add.at(links, window, products)
        self.links = np.r_[self.links, links]
        self.size += len(text) + len(head)


class Aligned(NamedTuple):
    """A slice of texts: numbers per text, shown groups, and their distinct pairs (text, pair, times), sorted."""

    counts: dict[str, np.ndarray]
    shown: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def tokens(texts: list[str], tokenizer) -> tuple[list[np.ndarray], list[bytes]]:
    """Ids of texts, and the bytes that they stand for."""
    encode, known = tokenizer
    ids = encode(texts)
    return ids, [b"".join(map(known.pieces.__getitem__, own.tolist())) for own in ids]


def align_texts(texts: list[str | None], one, two, memo: Windows) -> Aligned:
    count = len(texts)
    asked = [k for k, t in enumerate(texts) if t]
    given = [texts[k] for k in asked]
    ids_a, bytes_a = tokens(given, one)
    ids_b, bytes_b = tokens(given, two)
    raw = [b" " + t.encode() for t in given]
    good = [k for k in range(len(given)) if bytes_a[k] == raw[k] == bytes_b[k]]
    own = np.array([asked[k] for k in good], np.int64)
    ids_a, ids_b = [ids_a[k] for k in good], [ids_b[k] for k in good]
    a, b = Tokens.of(ids_a, one[1]), Tokens.of(ids_b, two[1])
    # Shared ends before tokens that begin with a space in both; every text begins with one.
    spaced = np.zeros((2, int(a.begin[-1]) + 1), bool)
    spaced[0, a.begin[:-1][one[1].spaced[a.ids]]] = True
    spaced[1, b.begin[:-1][two[1].spaced[b.ids]]] = True
    shared = spaced[0] & spaced[1]
    cuts = np.flatnonzero(shared)
    at_a, at_b = (np.r_[np.flatnonzero(shared[t.begin[:-1]]), len(t.ids)] for t in (a, b))
    numbers = memo.numbers(a, b, at_a, at_b)
    sizes = np.array([len(raw[k]) for k in good], np.int64)
    window_text = np.searchsorted(np.cumsum(sizes), cuts, "right")

    def per_text(values: np.ndarray) -> np.ndarray:
        out = np.zeros(count, np.int64)
        out[own] = np.bincount(window_text, values[numbers], len(own)).astype(np.int64)
        return out

    lengths = np.zeros((2, count), np.int64)
    lengths[0, own], lengths[1, own] = [len(i) for i in ids_a], [len(i) for i in ids_b]
    counts = {
        "n_a": lengths[0], "n_b": lengths[1],
        "n_groups": per_text(memo.groups), "n_links": per_text(memo.links),
    }
    shown, borders, listed = [""] * count, np.searchsorted(window_text, np.arange(len(own) + 1)).tolist(), numbers.tolist()
    for k, text in enumerate(own.tolist()):
        shown[text] = "".join([memo.shown[n] for n in listed[borders[k] : borders[k + 1]]])[:-1]
    # Windows of a text, each kind once with its number, then their pairs, each once.
    kinds = len(memo.shown)
    code, times = np.unique(window_text * max(kinds, 1) + numbers, return_counts=True)
    text, kind = code // max(kinds, 1), code % max(kinds, 1)
    many = memo.first[kind + 1] - memo.first[kind]
    place = spread(memo.first[kind], many)
    found, pair_number = np.unique(memo.pairs[place], return_inverse=True)
    code, back = np.unique(np.repeat(text, many) * max(len(found), 1) + pair_number, return_inverse=True)
    total = np.bincount(back, memo.weights[place] * np.repeat(times, many), len(code)).astype(np.int64)
    return Aligned(counts, shown, own[code // max(len(found), 1)], found[code % max(len(found), 1)], total)


def block_of(number: int, held: list[tuple[pa.Array, Aligned]], groups: bool) -> dict:
    """A row of packed texts; ``pairs`` holds its distinct pairs and the number of its texts that hold each."""
    rows = np.cumsum([0, *[len(ids) for ids, _ in held]])
    text = np.concatenate([part.text + k for k, (_, part) in zip(rows, held, strict=False)])
    pairs, place = np.unique(np.concatenate([part.pair for _, part in held]), return_inverse=True)
    shown = [s for _, part in held for s in part.shown]
    packed = {
        "ids": [k for ids, _ in held for k in ids.to_pylist()],
        "counts": {k: np.concatenate([part.counts[k] for _, part in held]) for k in held[0][1].counts},
        "sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown],
        "groups": shown if groups else None,
        "text": text.astype(np.int32),
        "place": place.astype(np.int32),
        "times": np.concatenate([part.times for _, part in held]),
    }
    own = np.stack([pairs, np.bincount(place, minlength=len(pairs))])
    return {"block": [number], "texts": [squeeze(pickle.dumps(packed))], "pairs": [squeeze(own.astype(np.int64).tobytes())]}


def blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int, groups: bool) -> DataFrame:
    def work(batches):
        one, two = byte_level(path_a), sentence_pieces(path_b)
        number = TaskContext.get().partitionId() << 33
        memo, held, size = Windows(one[1], two[1]), [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in W.slices(W.text_column(batch, "text")):
                if memo.size > MEMO_SIZE:
                    memo = Windows(one[1], two[1])
                rows = texts.slice(part.lo, part.hi - part.lo).to_pylist()
                held.append((ids.slice(part.lo, part.hi - part.lo), align_texts(rows, one, two, memo)))
                size += len(part.data) + 64 * len(rows)
                if size >= block_bytes:
                    yield block_of(number, held, groups)
                    number, held, size = number + 1, [], 0
        if held:
            yield block_of(number, held, groups)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(scan(own, work, "block long, texts binary, pairs binary"), "aligned")


def block_pairs(packed: DataFrame) -> DataFrame:
    """``(block, a, b, docs)``: the distinct pairs of every block with the number of its texts that hold them."""

    def work(batches):
        for batch in batches:
            for block, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair, docs = np.frombuffer(unsqueeze(pairs), np.int64).reshape(2, -1)
                yield {"block": np.full(len(pair), block), "a": (pair >> 32).astype(np.int32), "b": (pair & LOW).astype(np.int32), "docs": docs}

    return scan(packed.select("block", "pairs"), work, "block long, a int, b int, docs long")


def counted(pairs: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: texts that hold a pair linked, and whether no other pair of its first token has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def pair_counts(docs: DataFrame, path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """A translation table: ``a, b, count, best`` for every pair of token ids that some text holds linked."""
    return counted(block_pairs(blocks(docs, path_a, path_b, BLOCK_BYTES, False)))


def token_alignment(
    docs: DataFrame,
    path_a: str = f"{FOLDER}/byte_bpe_50k.json",
    path_b: str = f"{FOLDER}/piece_bpe_32k.model",
    groups: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs`` (doc_id, text).

    Tokenizer A is a byte-level file and reads a space and the text, B a sentence-piece model that adds the space itself. Byte
    offsets where tokens of both end cut them into groups; all tokens of a group's two sides are linked. ``n_best`` are
    the links whose count is the highest of their A token, ``count_sum`` adds up the counts of all links. With ``groups`` the
    alignment itself comes too (``a1,a2|b1;a3|b2,b3``: ids of both sides, group by group), else its digest only.

    Texts that are NULL or empty, or that the tokens of either side do not spell byte for byte, have no tokens: all numbers are 0
    and the digest is empty. Repeated rows count as texts of their own; a NULL id is kept, other columns are ignored. A
    task holds one block of texts (``block_bytes``, or one longer text with its tokens).
    """
    packed = blocks(docs, path_a, path_b, block_bytes, groups)
    pairs = block_pairs(packed)
    known = pairs.drop("docs").join(counted(pairs), ["a", "b"])
    rows = known.select("block", "a", "b", "count", "best", F.lit(None).cast("binary").alias("texts"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("a", "int"), ("b", "int"), ("count", "long"), ("best", "boolean"))]
    rows = rows.union(packed.select("block", *none, "texts"))

    def work(table: pa.Table) -> dict:
        texts = table.column("texts").combine_chunks()
        held = pickle.loads(unsqueeze(texts.drop_null()[0].as_py()))
        own = table.filter(table.column("a").is_valid())
        pair = own.column("a").to_numpy().astype(np.int64) << 32 | own.column("b").to_numpy()
        order = np.argsort(pair)  # the block's distinct pairs, in the order in which it numbered them
        count = own.column("count").to_numpy()[order][held["place"]]
        best = own.column("best").to_numpy()[order].astype(bool)[held["place"]]
        n_best, count_sum = np.zeros(len(held["ids"]), np.int64), np.zeros(len(held["ids"]), np.int64)
        np.add.at(n_best, held["text"], held["times"] * best)
        np.add.at(count_sum, held["text"], held["times"] * count)
        out = {"doc_id": held["ids"], **{k: v.tolist() for k, v in held["counts"].items()}}
        out |= {"n_best": n_best.tolist(), "count_sum": count_sum.tolist(), "groups_sha256": held["sha256"]}
        return out | ({"groups": held["groups"]} if groups else {})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return each_run(rows, ["block"], work, schema + (", groups string" if groups else ""))
