"""Language identification, hard negatives and token alignment on small tables against brute force."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contentlake.llm import align, hard_negatives, language
from contentlake.llm import words as W
from contentlake.llm.queries import op11_language, op13_token_alignment

# --- hard negatives -----------------------------------------------------------------------------


def model_negatives(rows, asks, k=5, low=80, high=100):
    """Rows of (id, label, vector) -> the answer, pair by pair in whole numbers."""

    def whole(v):
        if v is None or any(x is None or not np.isfinite(256.0 * x) for x in v):
            return None
        return [int(np.floor(256.0 * x)) for x in v]

    kept = [(i, label, whole(v)) for i, label, v in rows]
    kept = [r for r in kept if r[1] is not None and r[2] is not None]
    out = []
    for at, (anchor, label, v) in enumerate(kept):
        if not asks(anchor):
            continue
        found = []
        for other, (i, own, w) in enumerate(kept):
            if other != at:
                score = sum(x * y for x, y in zip(v, w, strict=False))
                found.append((-max(min(score, 2**63 - 1), 1 - 2**63), i is None, i or 0, own == label))
        found.sort(key=lambda f: f[:3])
        for s, none, i, _ in [f for f in found if f[3]][:k]:
            own = [f for f in found if not f[3] and low * -s <= 100 * -f[0] <= high * -s][:k]
            for rank, (t, none_t, j, _) in enumerate(own, 1):
                out.append((anchor, None if none else i, rank, None if none_t else j, -s, -t))
    return sorted(out, key=repr)


def vectors_of(spark, rows):
    schema = "vec_id long, label int, embedding array<double>, score long, anchor string, slot int, `block` int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)


def mined(spark, rows, **settings):
    got = hard_negatives.hard_negatives(
        vectors_of(spark, rows), F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % 10 == 0, **settings
    )
    return sorted(map(tuple, got.collect()), key=repr)


def vector_rows(seed, count, labels=4, width=6, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(0.4, spread, (count, width)).round(2)
    return [(k, int(rng.integers(labels)), v.tolist()) for k, v in enumerate(rows)]


def test_negatives_equal_model(spark):
    rows = vector_rows(1, 120)
    rows += [rows[10]] * 3 + [rows[11]] * 2 + [(13, 1, rows[10][2]), (10, 3, rows[3][2]), (None, 1, rows[5][2]), (None, 0, rows[5][2])]
    rows += [(140, None, [1.0] * 6), (150, 1, None), (160, 1, [1.0, None]), (161, 1, [float("nan")] * 6), (162, 2, [float("inf")])]
    rows += [(170, 1, []), (171, 2, []), (180, 1, [1.0, 2.0]), (181, 0, [0.5] * 9), (2**63 - 1, 2, rows[7][2]), (-20, 0, rows[8][2])]
    for settings in ({}, {"block_anchors": 3, "group_rows": 20}):
        assert mined(spark, rows, **settings) == model_negatives(rows, lambda i: i is not None and i % 10 == 0)


def test_negatives_ties_and_large_values(spark):
    same = [(k, k % 3, [1.0, 0.5]) for k in range(300)]
    assert mined(spark, same) == model_negatives(same, lambda i: i % 10 == 0)
    rng = random.Random(3)
    for scale in (1e3, 1e6, 1e12, 1e40):
        rows = [(k, k % 2, [rng.choice([1.0, 0.9, 0.99]) * scale, rng.random() * scale]) for k in range(60)]
        assert mined(spark, rows) == model_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_many_labels_low_scores_and_settings(spark):
    rows = vector_rows(5, 90, labels=40, spread=2.0)
    for settings, model in (({}, {}), ({"low": 10, "high": 90}, {"low": 10, "high": 90}), ({"positives": 2, "negatives": 2}, {"k": 2})):
        assert mined(spark, rows, **settings) == model_negatives(rows, lambda i: i % 10 == 0, **model)


def test_negatives_of_empty_tables(spark):
    assert mined(spark, vector_rows(1, 20)[:0]) == []
    assert mined(spark, [r for r in vector_rows(1, 20) if r[0] % 10]) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


# --- language -----------------------------------------------------------------------------------


def test_language_gradient():
    shape = language.Shape(window=12, widths=(1, 3), embedding=3, filters=4)
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in language.new_model(shape, 3, 1).items()}
    model["bias"] += rng.normal(size=model["bias"].shape)  # away from the bend at 0
    cells = rng.integers(97, 101, (5, shape.window + shape.reach - 1)).astype(np.int16)
    cells[:, -4:] = language.PAD
    slope = rng.normal(size=(5, 3))
    _, kept = language.forward(model, cells, shape)
    grads = language.backward(model, cells, kept, slope, shape)
    mask = {"kernel": language.used(shape)}
    for name, value in model.items():
        flat = value.reshape(-1)
        for at in rng.choice(flat.size, 30):
            if name == "bytes" and at >= language.PAD * shape.embedding or name == "kernel" and not mask["kernel"].reshape(-1)[at]:
                continue
            before = flat[at]
            flat[at] = before + 1e-6
            up = (language.forward(model, cells, shape)[0] * slope).sum()
            flat[at] = before - 1e-6
            down = (language.forward(model, cells, shape)[0] * slope).sum()
            flat[at] = before
            assert abs((up - down) / 2e-6 - grads[name].reshape(-1)[at]) < 1e-4, name


def test_language_windows_cover_all_bytes():
    shape = language.Shape(window=16, widths=(2, 5), embedding=2, filters=2)
    texts = [0, 1, 4, 5, 15, 16, 17, 28, 29, 100, 0]
    offsets = np.cumsum([0, *texts])
    starts, sizes, text = language.windows_of(offsets, shape)
    for k, size in enumerate(texts):
        runs = {s + i for s, n in zip(starts[text == k], sizes[text == k], strict=True) for i in range(max(n - shape.reach + 1, 0))}
        assert runs == set(range(offsets[k], offsets[k] + max(size - shape.reach + 1, 0)))
        seen = {s + i for s, n in zip(starts[text == k], sizes[text == k], strict=True) for i in range(n)}
        assert seen == set(range(offsets[k], offsets[k + 1]))


def test_language_forward_equals_loops():
    shape = language.Shape(window=10, widths=(2, 3), embedding=2, filters=2)
    model = language.new_model(shape, 2, 4)
    data = np.frombuffer(b"some bytes of a text", np.uint8)
    part = W.Slice(0, 1, data, np.array([0, len(data)]))
    want, weight = np.zeros(2), 0
    starts, sizes, _ = language.windows_of(part.offsets, shape)
    for s, n in zip(starts, sizes, strict=True):
        rows = [model["bytes"][data[s + i]] if i < n else np.zeros(2) for i in range(shape.window + shape.reach - 1)]
        best = [max(sum(rows[t + k] @ model["kernel"][2 * k : 2 * k + 2, f] for k in range(3)) for t in range(shape.window)) for f in range(4)]
        want += n * (np.maximum(np.array(best) + model["bias"], 0) @ model["out"] + model["shift"])
        weight += n
    assert np.allclose(language.text_logits(model, part, shape)[0], want / weight, atol=1e-5)


def sentences(seed, lang, count):
    rng = random.Random(seed)
    words = {"en": "the and of this that is with house water", "de": "der die und ist mit haus wasser über nicht"}[lang].split()
    return " ".join(rng.choice(words) for _ in range(count))


def test_language_cases(spark):
    rows = [(k, sentences(k, "en" if k % 2 else "de", 3 + k % 40), "en" if k % 2 else "de") for k in range(200)]
    odd = [(None, rows[0][1], "zz"), (500, None, "en"), (501, "", "de"), (502, "12 34 !", "en"), (503, sentences(9, "en", 90000), None), rows[4], rows[4]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, lang string, key long, cells string")
    got = language.language(docs, steps=150).collect()
    assert len(got) == len(rows) + len(odd)
    true = dict((r[0], r[2]) for r in rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.95 * len(held) > 20
    assert [r["lang_pred"] for r in got if r["doc_id"] == 503] == ["en"]
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 4}) == 1


def test_language_never_learns_held_out_rows(spark):
    rows = [(k, sentences(k, "en" if k % 2 else "de", 9), "en" if k % 2 else "de") for k in range(60)]
    changed = [(k, t, "wrong" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    one, two = (sorted(map(tuple, language.language(spark.createDataFrame(r, schema), steps=30).collect())) for r in (rows, changed))
    assert one == two


def test_language_with_nothing_to_learn(spark):
    for rows in ([], [(1, "some text", None)], [(None, "some text", "en")], [(1, "123", "en")]):
        got = language.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * len(rows)


def test_language_sample_is_bounded(spark):
    rows = [(3 * k, f"text number {k} of a language " * 20, "one" if k % 3 else "two") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows = language.training_windows(docs, language.Shape(), 30, 50, 1).collect()
    assert len(windows) == 50 and {w["lang"] for w in windows} == {"one", "two"}


def test_language_query_held_out_accuracy(spark, folder):
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in op11_language(spark, folder).collect() if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == true[r["doc_id"]] for r in got)
    assert right >= 0.9 * len(got) > 20


# --- alignment ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return align.byte_level(f"{align.FOLDER}/byte_bpe_50k.json"), align.sentence_pieces(f"{align.FOLDER}/piece_bpe_32k.model")


def model_alignment(rows, tokenizers):
    """(doc_id, text) rows -> the answer, from byte offsets alone."""
    (_, known_a), (encode_b, known_b) = tokenizers
    library = Tokenizer.from_file(f"{align.FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    held, links_of = [], []
    for _, text in rows:
        a, b = (library.encode(" " + text, add_special_tokens=False).ids, encode_b([text])[0].tolist()) if text else ([], [])
        raw = b" " + (text or "").encode()
        if b"".join(known_a.pieces[k] for k in a) != raw or b"".join(known_b.pieces[k] for k in b) != raw:
            a, b = [], []
        ends = []
        for ids, known in ((a, known_a), (b, known_b)):
            ends.append(np.cumsum([len(known.pieces[k]) for k in ids]).tolist())
        groups, links = [], []
        last = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            own = [k for k, e in zip(a, ends[0], strict=True) if last < e <= end]
            other = [k for k, e in zip(b, ends[1], strict=True) if last < e <= end]
            groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
            links += [(x, y) for x in own for y in other]
            last = end
        held.append((a, b, groups))
        links_of.append(links)
    counts = defaultdict(int)
    for links in links_of:
        for pair in set(links):
            counts[pair] += 1
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, _), (a, b, groups), links in zip(rows, held, links_of, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


ODD_TEXTS = [
    None, "", " ", "  two  spaces ", "tab\tand\nlines\n\n\nend", "naïve café ÀÉ", "日本語のテキスト without spaces", "👩‍👩‍👧 🏳️‍🌈 emoji",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]", "a" * 500, "x1y2z3" * 40, "ﬁne ｆｕｌｌ ½", " nbsp sep", "nul \x00 byte", "▁▁ mark ▁",
    "word " * 300, "I'll don't we've", "\r\n\r\n", "é" * 200, "﻿bom", "The end.The start", "https://a.b/c?d=e&f=%20",
]


def test_alignment_equals_model(spark, tokenizers):
    rng = random.Random(2)
    letters = ["a", "the", " ", "  ", "\n", "é", "日", "👍", "ing", ".", "1", "_", "<s>", "ß", "Th", "\t"]
    rows = list(enumerate(ODD_TEXTS)) + [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(None, "The end of it"), (7, "The end of it"), (7, "The end of it"), (2**63 - 1, "ring " * 5)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, a int, block long, texts string")
    want = model_alignment(rows, tokenizers)
    assert sum(r[1] > 0 for r in want) > 100
    for size in (1 << 22, 1):
        got = align.token_alignment(docs.repartition(3), block_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranks_encode_like_the_file(tokenizers, tmp_path):
    """A file that is no plain ranking goes to the library of the format, with the same ids."""
    path = f"{align.FOLDER}/byte_bpe_50k.json"
    note = json.load(open(path, encoding="utf-8"))
    note["normalizer"] = {"type": "Sequence", "normalizers": []}
    (tmp_path / "other.json").write_text(json.dumps(note), encoding="utf-8")
    texts = [t for t in ODD_TEXTS if t] + ["a" * 9000, " " * 3000, "".join(map(chr, range(1, 0x3000)))]
    one, two = tokenizers[0], align.byte_level(str(tmp_path / "other.json"))
    assert [i.tolist() for i in one[0](texts)] == [i.tolist() for i in two[0](texts)] and one[1].pieces == two[1].pieces


def test_alignment_shows_groups(spark, tokenizers):
    rows = [(1, "The reading of it"), (2, None), (3, "Wörter über alles")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in align.token_alignment(docs, groups=True).collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        assert bool(r["groups"]) == (r["n_groups"] > 0) and len(r["groups"].split(";")) == max(r["n_groups"], 1)
    pairs = {(r["a"], r["b"]): r["count"] for r in align.pair_counts(docs).collect()}
    assert sum(pairs.values()) > 0 and max(pairs.values()) <= 2


def test_alignment_forgets_windows(tokenizers, spark, monkeypatch):
    monkeypatch.setattr(align, "MEMO_SIZE", 10)
    memo = align.Windows(tokenizers[0][1], tokenizers[1][1])
    part = align.align_texts(["one two one two three", None, "one"], *tokenizers, memo)
    assert len(memo.shown) < 5 and part.counts["n_a"].tolist()[1] == 0 and part.shown[1] == ""


def test_alignment_of_empty_tables(spark):
    assert align.token_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = align.token_alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_query_equals_model(spark, folder, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") < 20000]
    whole = sorted(map(tuple, op13_token_alignment(spark, folder).collect()), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.token_alignment(docs).collect()), key=repr) == model_alignment(rows, tokenizers)
    assert len(whole) == spark.read.parquet(f"{folder}/documents.parquet").count()
