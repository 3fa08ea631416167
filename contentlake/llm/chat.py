"""Chat formatting by token-level assembly.

Each turn becomes ``<s>role[INST]text[/INST]</s>``. Role and text are encoded on their own, and the marks are reserved ids spliced
between them, beyond the vocabulary, so no text can produce one. In the written form, control strings occurring in a
text get a backslash after their first character (``<\\/s>``); one more where there are some already, so that it can be undone.
The loss covers the texts of the assistant. Places of segments and the loss mask are running sums of segment lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wn
from pyspark.sql import functions as F

from contentlake.llm.common import scan

MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
CONTROL = re.compile(r"(<\\*)(?=/?s>)|(\[\\*)(?=/?INST\])")
ESCAPED = re.compile(r"(<\\*)\\(?=/?s>)|(\[\\*)\\(?=/?INST\])")
# Fixed value: the published split pattern of the 50k byte-level vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEARNT = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] or m[2], text)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def assemble(encoder: tiktoken.Encoding, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of a turn."""
    reserved = encoder.n_vocab + np.arange(len(MARKS))
    parts = [encoder.encode_ordinary(escape(t)) for t in (role, text)]
    segments = [reserved[:1], parts[0], reserved[1:2], parts[1], reserved[2:]]
    ends = np.cumsum([len(s) for s in segments])
    steps = np.zeros(ends[-1] + 1, np.int32)
    if role == LEARNT:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps[:-1]).astype(np.int8)


def read_back(encoder: tiktoken.Encoding, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Role, text, text under the mask and written form of a turn, from its ids and mask alone."""
    reserved = encoder.n_vocab
    cuts = np.flatnonzero(ids >= reserved)
    pieces = [encoder.decode_bytes(ids[a + 1 : b].tolist()).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    learnt = encoder.decode_bytes(ids[mask > 0].tolist()).decode()
    written = MARKS[0] + "".join(p + MARKS[int(ids[c]) - reserved] for p, c in zip(pieces, cuts[1:], strict=True))
    return unescape(pieces[0]), unescape(pieces[1]), unescape(learnt), written


def format_turns(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, place, start, ids, mask`` per turn of ``conversations`` (conv_id, turn, role, text).

    Turns go by turn, then role and text (NULL turns first); a NULL role or text is empty, a NULL conv_id is a conversation
    of its own. ``place`` numbers the turns of a conversation, ``start`` is the place of the turn's first token in it. A row
    per turn, so a conversation may be of any length. Repeated rows are repeated turns; other columns are ignored.
    """

    def work(batches):
        encoder = encoding(vocabulary)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [assemble(encoder, r, t) for r, t in zip(roles, texts, strict=True)]
            yield {c: batch.column(c) for c in ("conv_id", "turn", "role", "text")} | {
                "ids": [i for i, _ in made],
                "mask": [m.tobytes() for _, m in made],
            }

    blank = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    rows = scan(rows, work, "conv_id long, turn long, role string, text string, ids array<int>, mask binary")
    order = Wn.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = F.sum(F.size("ids").cast("long")).over(order.rowsBetween(Wn.unboundedPreceding, Wn.currentRow))
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("start", so_far - F.size("ids"))
    return placed.select("conv_id", "place", "start", "ids", "mask")


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, n_loss_tokens long"
)


def conversation_digests(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per conversation what is read back from ``turns`` as ``format_turns`` gives them, that is together and in order. They
    stream through running hashes, one turn at a time."""

    def work(batches):
        encoder, state, out = encoding(vocabulary), None, []

        def close():
            key, numbers, all_turns, learnt = state
            digests = {"turns_sha256": all_turns.hexdigest(), "loss_sha256": learnt.hexdigest()}
            out.append({"conv_id": key} | numbers | digests)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")]
            for key, ids, mask in zip(*columns, strict=True):
                if state is None or key != state[0]:
                    if state is not None:
                        close()
                    numbers = dict.fromkeys(("n_turns", "loss_chars", "formatted_chars", "n_tokens", "n_loss_tokens"), 0)
                    state = (key, numbers, hashlib.sha256(), hashlib.sha256())
                ids, mask = np.array(ids), np.frombuffer(mask, np.int8)
                role, text, loss, written = read_back(encoder, ids, mask)
                numbers = state[1]
                numbers["n_turns"] += 1
                numbers["loss_chars"] += len(loss)
                numbers["formatted_chars"] += len(written)
                numbers["n_tokens"] += len(ids)
                numbers["n_loss_tokens"] += int(mask.sum())
                state[2].update(f"{role}\n{text}\n".encode())
                state[3].update(loss.encode())
            if len(out) >= 1000:
                yield {k: [o[k] for o in out] for k in out[0]}
                out.clear()
        if state is not None:
            close()
            yield {k: [o[k] for o in out] for k in out[0]}

    return scan(turns, work, DIGEST)


def worst_case(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose turns say the template's own control strings."""
    said = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    columns = ["conv_id", "turn", "role", "text"]
    more = conversations.sparkSession.createDataFrame(said, "conv_id long, turn long, role string, text string")
    return conversations.select(*columns).union(more)
