"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the embedding of its hash plus the embeddings of its character triples (bytes, with word borders), so that
unseen forms of a stem are known by their characters. Two gated recurrent passes read each window of words, attention
pools their states, and a window gets a logit. Every text is covered by overlapping windows; its score is that of its worst
window. Training sees labels of texts only: of each training text, the highest windows of the moment take its label.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlake.llm import words as W
from contentlake.llm.common import scan

U64 = np.uint64
F32 = np.float32
CODES = W.byte_codes(fold=True)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int64)


class Shape(NamedTuple):
    """Sizes of the network and of a window; embeddings are hashed into 2**bits rows."""

    window: int = 32
    stride: int = 16
    width: int = 16
    hidden: int = 8
    word_bits: int = 15
    char_bits: int = 14


class Vocabulary(NamedTuple):
    """Distinct words of a slice: rows of the word table, and rows of the character table with their borders."""

    word_rows: np.ndarray
    char_rows: np.ndarray
    borders: np.ndarray


def read_words(part: W.Slice, shape: Shape) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Vocabulary, the vocabulary number of every word, and the first word of every text."""
    words = W.find_words(part, W.LETTERS)
    hashes = W.word_hashes(part, words, CODES)
    distinct, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    starts, sizes = words.starts[first], (words.ends - words.starts)[first]
    borders = np.r_[0, np.cumsum(sizes)]
    place = np.arange(borders[-1]) + np.repeat(starts - borders[:-1], sizes)
    letters = FOLD[part.data]
    before = letters[np.maximum(place - 1, 0)]
    after = letters[np.minimum(place + 1, max(len(letters) - 1, 0))]
    before[borders[:-1]] = 0
    after[borders[1:] - 1] = 0
    triple = (before << 16 | letters[place] << 8 | after).astype(U64)
    char_rows = (W.mix(triple) >> U64(64 - shape.char_bits)).astype(np.int64)
    word_rows = (distinct >> U64(64 - shape.word_bits)).astype(np.int64)
    return Vocabulary(word_rows, char_rows, borders), numbers, words.first


def window_starts(count: int, shape: Shape) -> np.ndarray:
    """Overlapping windows over all ``count`` words; the last one ends with the text."""
    if count <= shape.window:
        return np.zeros(min(count, 1), np.int64)
    return np.unique(np.r_[np.arange(0, count - shape.window, shape.stride), count - shape.window])


def windows_of(first: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of words and text of every window of a slice."""
    counts = np.diff(first)
    own = [window_starts(c, shape) + a for c, a in zip(counts.tolist(), first[:-1].tolist(), strict=True)]
    text = np.repeat(np.arange(len(counts)), [len(o) for o in own])
    starts = np.concatenate(own) if own else np.zeros(0, np.int64)
    return starts, np.minimum(counts[text], shape.window), text


def new_model(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    e, h = shape.width, shape.hidden

    def normal(*size, scale):
        return rng.normal(0, scale, size).astype(F32)

    return {
        "words": normal(1 << shape.word_bits, e, scale=0.1),
        "chars": normal(1 << shape.char_bits, e, scale=0.1),
        "inputs": normal(e, 6 * h, scale=e**-0.5),
        "bias": np.zeros(6 * h, F32),
        "ahead": normal(h, 3 * h, scale=h**-0.5),
        "back": normal(h, 3 * h, scale=h**-0.5),
        "attend": normal(2 * h, scale=0.1),
        "out": normal(2 * h, scale=0.3),
        "shift": np.zeros(1, F32),
    }


def embed(model, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input vector of each distinct word, and the scale of its character sum."""
    scale = (1 / np.sqrt(np.maximum(np.diff(vocabulary.borders), 1))).astype(F32)[:, None]
    if len(vocabulary.word_rows) == 0:
        return np.zeros((0, model["words"].shape[1]), F32), scale
    chars = np.add.reduceat(model["chars"][vocabulary.char_rows], vocabulary.borders[:-1], axis=0)
    return model["words"][vocabulary.word_rows] + chars * scale, scale


def gate(x: np.ndarray) -> np.ndarray:
    return F32(0.5) + F32(0.5) * np.tanh(F32(0.5) * x)


def recur(projected: np.ndarray, numbers: np.ndarray, inside: np.ndarray | None, weights: np.ndarray, keep: bool):
    """States of one pass over windows (rows of ``numbers``, in reading order); ``keep`` also returns what backward needs."""
    size, steps, h = len(numbers), numbers.shape[1], len(weights)
    state = np.zeros((size, h), F32)
    states, memory = np.empty((steps, size, h), F32), []
    for t in range(steps):
        x, u = projected.take(numbers[:, t], axis=0), state @ weights
        zr = gate(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        after = new + z * (state - new)
        if inside is not None:
            after = np.where(inside[:, t : t + 1], after, state)
        if keep:
            memory.append((state, z, r, new, u[:, 2 * h :]))
        state = states[t] = after
    return states, memory


def forward(model, inputs: np.ndarray, numbers: np.ndarray, inside: np.ndarray | None, keep: bool = False):
    """Logits of windows; ``inputs`` are the word vectors, with a zero row at the end for places past a short text."""
    h = len(model["ahead"])
    projected = inputs @ model["inputs"] + model["bias"]
    turned = None if inside is None else inside[:, ::-1]
    one, memory_one = recur(np.ascontiguousarray(projected[:, : 3 * h]), numbers, inside, model["ahead"], keep)
    two, memory_two = recur(np.ascontiguousarray(projected[:, 3 * h :]), numbers[:, ::-1], turned, model["back"], keep)
    states = np.concatenate([one, two[::-1]], axis=2)
    score = states @ model["attend"]
    if inside is not None:
        score = np.where(inside.T, score, F32(-1e9))
    score = np.exp(score - score.max(axis=0))
    share = score / score.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    logits = pooled @ model["out"] + model["shift"]
    return logits, (projected, states, share, pooled, memory_one, memory_two)


def backward(model, inputs, numbers, inside, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the word vectors for d loss / d logit = ``slope``."""
    projected, states, share, pooled, memory_one, memory_two = kept
    h = len(model["ahead"])
    grads = {"out": pooled.T @ slope, "shift": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * model["out"]
    d_share = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    grads["attend"] = np.einsum("tb,tbh->h", d_score, states)
    d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * model["attend"]
    d_projected = np.zeros_like(projected)
    for name, memory, at, turn in (("ahead", memory_one, 0, False), ("back", memory_two, 3 * h, True)):
        weights, d_weights = model[name], np.zeros_like(model[name])
        d_own = d_states[::-1, :, h:] if turn else d_states[:, :, :h]
        order = numbers[:, ::-1] if turn else numbers
        live = None if inside is None else (inside[:, ::-1] if turn else inside)
        d_state = np.zeros((len(numbers), h), F32)
        for t in range(numbers.shape[1] - 1, -1, -1):
            state, z, r, new, u = memory[t]
            d_after = d_state + d_own[t]
            passed = np.zeros_like(d_after)
            if live is not None:
                on = live[:, t : t + 1]
                passed, d_after = np.where(on, 0, d_after), np.where(on, d_after, 0)
            d_new = d_after * (1 - z) * (1 - new * new)
            d_z = d_after * (state - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_projected[:, at : at + 3 * h], order[:, t], d_x)
            d_weights += state.T @ d_u
            d_state = d_u @ weights.T + d_after * z + passed
        grads[name] = d_weights
    grads["bias"] = d_projected.sum(axis=0)
    grads["inputs"] = inputs.T @ d_projected
    return grads, d_projected @ model["inputs"].T


def grid(starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, shape: Shape, pad: int):
    """Vocabulary numbers of windows (``pad`` past the end of a text), and which places are inside (None: all)."""
    place = np.arange(shape.window)
    inside = place < sizes[:, None]
    cells = numbers[np.minimum(starts[:, None] + place, len(numbers) - 1)]
    return np.where(inside, cells, pad), None if inside.all() else inside


def window_logits(model, inputs, starts, sizes, numbers, shape: Shape, step: int = 2048) -> np.ndarray:
    """Logits of all windows, a bounded number of them at a time."""
    out = np.zeros(len(starts), F32)
    for k in range(0, len(starts), step):
        cells, inside = grid(starts[k : k + step], sizes[k : k + step], numbers, shape, len(inputs) - 1)
        out[k : k + step], _ = forward(model, inputs, cells, inside)
    return out


def train(texts: list[str], labels: np.ndarray, shape: Shape, epochs: int, rate: float, most_windows: int, seed: int) -> dict:
    """Adagrad over batches of texts. All windows of a text are scored; at most ``most_windows`` of them, the highest, are learned from."""
    model, rng = new_model(shape, seed), np.random.default_rng(seed)
    sums = {k: np.full(v.shape, 1e-8, F32) for k, v in model.items()}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(F32)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 48)):
            column = pa.array([texts[i] for i in batch], pa.large_string())
            part = next(W.slices(column, 1 << 60), None)
            if part is None:
                continue
            vocabulary, numbers, first = read_words(part, shape)
            starts, sizes, owner = windows_of(first, shape)
            if len(starts) == 0:
                continue
            inputs, scale = embed(model, vocabulary)
            inputs = np.vstack([inputs, np.zeros((1, shape.width), F32)])
            logits = window_logits(model, inputs, starts, sizes, numbers, shape)
            # The highest quarter of a toxic text's windows, and the four highest of a clean text's, carry its label; in
            # the first epoch all of them do, or as many as may.
            order = np.lexsort((-logits, owner))
            begin = np.searchsorted(owner[order], np.arange(len(batch)))
            rank = np.arange(len(order)) - begin[owner[order]]
            total = np.bincount(owner, minlength=len(batch))[owner[order]]
            toxic = labels[batch][owner[order]] == 1
            quarter = np.minimum(np.maximum(1, total // 4), max(1, most_windows // 4))
            top = order[rank < (most_windows if epoch == 0 else np.where(toxic, quarter, 4))]
            cells, inside = grid(starts[top], sizes[top], numbers, shape, len(inputs) - 1)
            used, cells = np.unique(cells, return_inverse=True)
            cells = cells.reshape(len(top), shape.window)
            logits, kept = forward(model, inputs[used], cells, inside, keep=True)
            target = labels[batch][owner[top]].astype(F32)
            share = weight[batch][owner[top]] / np.bincount(owner[top], minlength=len(batch))[owner[top]]
            slope = ((gate(logits) - target) * share / len(batch)).astype(F32)
            grads, d_inputs = backward(model, inputs[used], cells, inside, kept, slope)
            for name, grad in grads.items():
                sums[name] += grad * grad
                model[name] -= F32(rate) * grad / np.sqrt(sums[name])
            real = used < len(inputs) - 1
            used, d_inputs = used[real], d_inputs[real].astype(F32)
            sizes = np.diff(vocabulary.borders)[used]
            chars = np.concatenate([vocabulary.char_rows[vocabulary.borders[u] : vocabulary.borders[u + 1]] for u in used])
            for name, rows, grad in (
                ("words", vocabulary.word_rows[used], d_inputs),
                ("chars", chars, np.repeat(d_inputs * scale[used], sizes, axis=0)),
            ):
                touched, inverse = np.unique(rows, return_inverse=True)
                grad_rows = np.zeros((len(touched), shape.width), F32)
                np.add.at(grad_rows, inverse, grad)
                sums[name][touched] += grad_rows * grad_rows
                model[name][touched] -= F32(rate) * grad_rows / np.sqrt(sums[name][touched])
    return model


def score_slice(model, part: W.Slice, shape: Shape) -> np.ndarray:
    """Score of each text: that of its highest window, 0 without words."""
    best = best_logits(model, part, shape)
    return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -50, 50))), 0.0)


def best_logits(model, part: W.Slice, shape: Shape, step: int = 2048) -> np.ndarray:
    """Logit of each text's highest window, minus infinity without words."""
    vocabulary, numbers, first = read_words(part, shape)
    starts, sizes, owner = windows_of(first, shape)
    best = np.full(part.hi - part.lo, -np.inf)
    inputs, _ = embed(model, vocabulary)
    inputs = np.vstack([inputs, np.zeros((1, shape.width), F32)])
    full = sizes == shape.window  # whole windows need no marks of what is inside
    for chosen in (np.flatnonzero(full), np.flatnonzero(~full)):
        for k in range(0, len(chosen), step):
            own = chosen[k : k + step]
            cells, inside = grid(starts[own], sizes[own], numbers, shape, len(inputs) - 1)
            logits, _ = forward(model, inputs, cells, inside)
            np.maximum.at(best, owner[own], logits)
    return best


def calibrated(model, texts: list[str], labels: np.ndarray, shape: Shape, toxic_share: float) -> dict:
    """Shift the logits so that score 0.5 errs least on texts that were not trained on, at the given share of toxic ones."""
    parts = W.slices(pa.array(texts, pa.large_string()))
    logits = np.concatenate([best_logits(model, part, shape) for part in parts]) if texts else np.zeros(0)
    known = np.isfinite(logits)
    logits, labels = logits[known], labels[known]
    if 0 < labels.sum() < len(labels):
        order = np.argsort(logits)
        cuts = (np.r_[logits[order][:1] - 1, logits[order]] + np.r_[logits[order], logits[order][-1:] + 1]) / 2
        below = labels[order]
        missed = np.r_[0, np.cumsum(below)] / labels.sum()
        wrong = 1 - np.r_[0, np.cumsum(1 - below)] / (1 - labels).sum()
        cost = toxic_share * missed + (1 - toxic_share) * wrong
        good = np.flatnonzero(cost <= cost.min() + 1e-12)
        model["shift"] = model["shift"] - F32(cuts[good].mean())
    return model


def learned(docs: DataFrame, labels: DataFrame, shape: Shape, most_texts: int, epochs: int, rate: float, most_windows: int, seed: int) -> bytes:
    """Weights learned from at most ``most_texts`` toxic and twice as many clean labelled texts outside the held-out fold."""
    train_rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    train_rows = train_rows.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    train_rows = train_rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    toxic_share = train_rows.agg(F.avg("toxic")).first()[0] or 0.0
    sample = [train_rows.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((0, 2 * most_texts), (1, most_texts))]
    sample = sample[0].union(sample[1])  # at most 3 * most_texts short rows
    texts = docs.join(F.broadcast(sample), "doc_id").filter("text IS NOT NULL").select("doc_id", "text", "toxic").distinct()
    # An id may have many texts: the bound holds for these too.
    order = F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text")
    texts = [texts.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((0, 2 * most_texts), (1, most_texts))]
    texts = texts[0].union(texts[1])

    def work(batches):
        rows = sorted({(d, t, x) for b in batches for d, t, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)})
        found = np.array([x for _, _, x in rows])
        # A fifth of the toxic texts, and the clean ones beyond most_texts (at least a fifth), only place the threshold.
        rank = np.empty(len(rows), np.int64)
        for c in (0, 1):
            own = np.flatnonzero(found == c)
            rank[own] = np.random.default_rng(seed).permutation(len(own))
        last = np.where(found == 1, (found == 1).sum() * 4 // 5, min(most_texts, (found == 0).sum() * 4 // 5))
        fit = rank < np.maximum(last, 1)
        model = None
        if 0 < found[fit].sum() < fit.sum():
            model = train([rows[k][1] for k in np.flatnonzero(fit)], found[fit], shape, epochs, rate, most_windows, seed)
            model = calibrated(model, [rows[k][1] for k in np.flatnonzero(~fit)], found[~fit], shape, toxic_share)
        yield {"model": [pickle.dumps(model)]}

    row = scan(texts.repartition(1), work, "model binary").first()  # none where Spark sees that a table is empty
    return row[0] if row else pickle.dumps(None)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def scorer(docs: DataFrame, labels: DataFrame, shape: Shape, most_texts: int, epochs: int, rate: float, most_windows: int, seed: int):
    """A function from Arrow batches with a text column to scores; without both classes to learn from all scores are 0."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    weights = docs.sparkSession.sparkContext.broadcast(learned(own, labels, shape, most_texts, epochs, rate, most_windows, seed))

    def scores(batches):
        model = pickle.loads(weights.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model is not None:
                for part in W.slices(W.text_column(batch, "text")):
                    out[part.lo : part.hi] = score_slice(model, part, shape)
            yield batch, out

    return scores


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    shape: Shape = Shape(),
    most_texts: int = 1000,
    epochs: int = 6,
    rate: float = 0.02,
    most_windows: int = 48,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text); labels are (doc_id, toxic).

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read. Training takes at most
    ``most_texts`` toxic and twice as many clean labelled texts, the first by hash of the id, in one task (part of them only
    places the threshold); all texts are scored whole, in windows that overlap by half. NULL, empty
    and wordless texts score 0, a NULL id is not held out, repeated rows are scored alike, other columns are ignored.
    """
    scores = scorer(docs, labels, shape, most_texts, epochs, rate, most_windows, seed)

    def work(batches):
        for batch, found in scores(batches):
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": found, "predicted": (found >= 0.5).astype(np.int32)}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return scan(own, work, "doc_id long, held_out boolean, score double, predicted int")


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, shape: Shape = Shape(), **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; ``settings`` as in ``toxicity``."""
    defaults = {"most_texts": 1000, "epochs": 6, "rate": 0.02, "most_windows": 48, "seed": 7}
    scores = scorer(docs, labels, shape, **(defaults | settings))

    def work(batches):
        for batch, found in scores(batches):
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(work, docs.schema)
