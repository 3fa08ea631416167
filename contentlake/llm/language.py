"""Language identification: a byte convolutional network, trained and run in numpy.

A text is read as UTF-8 bytes in fixed-length windows, each byte an embedding. Filters of several widths slide over a window,
each keeps its highest value (max pooling), and a softmax layer turns these into logits of the learned languages. The last
bytes of a window begin the next one, so that every run a filter can see lies whole in a window; a text's logits are the mean
of its windows', weighted by their bytes.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import scan

F32 = np.float32
PAD = 256  # a place past the end of a text; its embedding stays 0
UNKNOWN = "und"


class Shape(NamedTuple):
    """Bytes in a window, widths of the filters, size of an embedding, filters of each width."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4, 5)
    embedding: int = 8
    filters: int = 16

    @property
    def reach(self) -> int:
        return max(self.widths)

    @property
    def step(self) -> int:
        return self.window - self.reach + 1


def windows_of(offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of bytes and text of every window; together they cover all bytes of all texts."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(-(-(sizes - shape.reach + 1) // shape.step), 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[text] + number * shape.step
    return starts, np.minimum(offsets[text + 1] - starts, shape.window), text


def cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shape: Shape) -> np.ndarray:
    """The bytes of windows, padded behind; also past a full window, so that every byte begins a run of each width."""
    place = np.arange(shape.window + shape.reach - 1)
    cells = data[np.minimum(starts[:, None] + place, max(len(data) - 1, 0))].astype(np.int16)
    cells[place >= sizes[:, None]] = PAD
    return cells


def new_model(shape: Shape, classes: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    e, f = shape.embedding, shape.filters * len(shape.widths)
    model = {
        "bytes": rng.normal(0, 0.5, (PAD + 1, e)).astype(F32),
        "kernel": rng.normal(0, 1, (shape.reach * e, f)).astype(F32) * used(shape),
        "bias": np.zeros(f, F32),
        "out": rng.normal(0, f**-0.5, (f, classes)).astype(F32),
        "shift": np.zeros(classes, F32),
    }
    model["kernel"] /= np.sqrt(used(shape).sum(axis=0)).astype(F32)
    model["bytes"][PAD] = 0
    return model


def used(shape: Shape) -> np.ndarray:
    """Which rows of the common kernel a filter uses: a narrow filter sees the first places only."""
    widths = np.repeat(shape.widths, shape.filters)
    return (np.arange(shape.reach * shape.embedding)[:, None] < widths * shape.embedding).astype(F32)


def forward(model: dict, cells: np.ndarray, shape: Shape) -> tuple[np.ndarray, tuple]:
    """Logits of windows, and what ``backward`` needs."""
    rows = model["bytes"].take(cells, axis=0)
    runs = np.concatenate([rows[:, k : k + shape.window] for k in range(shape.reach)], axis=2)
    found = (runs.reshape(-1, runs.shape[2]) @ model["kernel"]).reshape(len(cells), shape.window, -1)
    pooled = np.maximum(found.max(axis=1) + model["bias"], 0)
    return pooled @ model["out"] + model["shift"], (runs, found, pooled)


def backward(model: dict, cells: np.ndarray, kept: tuple, slope: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Gradients for d loss / d logits = ``slope``: only the place a filter kept learns."""
    runs, found, pooled = kept
    d_pooled = (slope @ model["out"].T) * (pooled > 0)
    place = found.argmax(axis=1)
    window = np.arange(len(cells))[:, None]
    grads = {"out": pooled.T @ slope, "shift": slope.sum(axis=0), "bias": d_pooled.sum(axis=0)}
    grads["kernel"] = np.einsum("bfk,bf->kf", runs[window, place], d_pooled, optimize=True) * used(shape)
    d_runs = d_pooled[:, :, None] * model["kernel"].T
    grads["bytes"] = np.zeros_like(model["bytes"])
    for k in range(shape.reach):
        own = d_runs[:, :, k * shape.embedding : (k + 1) * shape.embedding]
        np.add.at(grads["bytes"], cells[window, place + k], own)
    grads["bytes"][PAD] = 0
    return grads


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(cells: np.ndarray, labels: np.ndarray, classes: int, shape: Shape, steps: int, batch: int, rate: float, seed: int) -> dict:
    """Adam over random windows, each class drawn equally often; the rate falls to 0."""
    model, rng = new_model(shape, classes, seed), np.random.default_rng(seed)
    own = [np.flatnonzero(labels == c) for c in range(classes)]
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(own[c]) for c in rng.integers(0, classes, batch)])
        logits, kept = forward(model, cells[chosen], shape)
        slope = softmax(logits)
        slope[np.arange(batch), labels[chosen]] -= 1
        grads = backward(model, cells[chosen], kept, (slope / batch).astype(F32), shape)
        for name, grad in grads.items():
            first[name] = F32(0.9) * first[name] + F32(0.1) * grad
            second[name] = F32(0.999) * second[name] + F32(0.001) * grad * grad
            mean, spread = first[name] / F32(1 - 0.9**step), second[name] / F32(1 - 0.999**step)
            model[name] -= F32(rate * (1 - (step - 1) / steps)) * mean / (np.sqrt(spread) + F32(1e-8))
    return model


def text_logits(model: dict, part: W.Slice, shape: Shape, step: int = 32) -> np.ndarray:
    """Mean logits of each text of a slice, 0 for an empty one."""
    starts, sizes, text = windows_of(part.offsets, shape)
    out = np.zeros((part.hi - part.lo, len(model["shift"])))
    weight = np.bincount(text, sizes, part.hi - part.lo)
    for k in range(0, len(starts), step):
        logits, _ = forward(model, cut(part.data, starts[k : k + step], sizes[k : k + step], shape), shape)
        np.add.at(out, text[k : k + step], logits * sizes[k : k + step, None])
    return out / np.maximum(weight, 1)[:, None]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def has_letter(text):
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def training_windows(docs: DataFrame, shape: Shape, most_texts: int, most_windows: int, seed: int) -> DataFrame:
    """``(lang, key, cells)``: at most ``most_windows`` windows of at most ``most_texts`` distinct labelled texts, drawn by hash.

    Languages take turns, so that a rare one is not crowded out. Only hashes are ranked; whole texts travel for the chosen.
    """
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.select("lang", "text", F.xxhash64(F.lit(seed), "text").alias("key"))

    def some(rows: DataFrame, n: int) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
        return rows.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", "key", "lang").limit(n).drop("turn")

    chosen = some(known.select("lang", "key").distinct(), most_texts)  # at most most_texts short rows
    texts = known.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def work(batches):
        for batch in batches:
            langs, keys = batch.column(0), batch.column(1).to_numpy()
            for part in W.slices(W.text_column(batch, "text")):
                starts, sizes, text = windows_of(part.offsets, shape)
                own = keys[part.lo : part.hi][text].astype(np.uint64)
                number = np.arange(len(text), dtype=np.uint64) - np.searchsorted(text, text).astype(np.uint64)
                order = W.mix(own + number * np.uint64(W.BASE)).view(np.int64)
                for k in range(0, len(starts), 4096):
                    cells = cut(part.data, starts[k : k + 4096], sizes[k : k + 4096], shape)
                    yield {
                        "lang": langs.take(text[k : k + 4096] + part.lo),
                        "key": order[k : k + 4096],
                        "cells": [c.tobytes() for c in cells],
                    }

    return some(scan(texts, work, "lang string, key long, cells binary"), most_windows)


def learned(docs: DataFrame, shape: Shape, most_texts: int, most_windows: int, steps: int, batch: int, rate: float, seed: int) -> bytes:
    """The languages and weights, or None where there is nothing to learn from."""

    def work(batches):
        rows = sorted({(lang, key, c) for b in batches for lang, key, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)})
        langs = sorted({lang for lang, _, _ in rows})
        model = None
        if langs:
            cells = np.stack([np.frombuffer(c, np.int16) for _, _, c in rows])
            labels = np.searchsorted(np.array(langs, object), np.array([lang for lang, _, _ in rows], object))
            model = train(cells, labels, len(langs), shape, steps, batch, rate, seed)
        yield {"model": [pickle.dumps((langs, model))]}

    windows = training_windows(docs, shape, most_texts, most_windows, seed)
    row = scan(windows.repartition(1), work, "model binary").first()  # none where Spark sees that a table is empty
    return row[0] if row else pickle.dumps(([], None))


def language(
    docs: DataFrame,
    shape: Shape = Shape(),
    most_texts: int = 4000,
    most_windows: int = 40000,
    steps: int = 400,
    batch: int = 128,
    rate: float = 0.01,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out, their languages are never read. Training takes at most
    ``most_windows`` windows (by hash, languages in turn) of at most ``most_texts`` distinct texts of the other rows with a
    language, in one task; all texts are scored whole. ``score`` is the softmax share of the predicted language. Texts that
    are NULL or have no letter, and all texts where there is nothing to learn from, are ``und`` with score 0. A NULL id is
    neither held out nor learned from. Repeated rows are scored alike, other columns are ignored.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    weights = docs.sparkSession.sparkContext.broadcast(learned(own, shape, most_texts, most_windows, steps, batch, rate, seed))

    def work(batches):
        langs, model = pickle.loads(weights.value)
        for found in batches:
            best = np.full(found.num_rows, -1)
            score = np.zeros(found.num_rows)
            lettered = found.column(3).to_numpy(zero_copy_only=False)
            if model is not None:
                for part in W.slices(W.text_column(found, "text")):
                    share = softmax(text_logits(model, part, shape))
                    best[part.lo : part.hi] = share.argmax(axis=1)
                    score[part.lo : part.hi] = share.max(axis=1)
            best[~lettered] = -1
            score[best < 0] = 0.0
            named = [langs[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            yield {"doc_id": found.column(0), "held_out": found.column(1), "lang_pred": named, "score": score}

    rows = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("lettered"))
    return scan(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
