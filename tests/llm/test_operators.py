"""Each operator on small hand-made tables against brute force: NULLs, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlake.llm import chat, common, decontaminate, line_dedup, minimisers, mixing, ngram_join, quality, queries, sharding
from contentlake.llm import substring_dedup, suffix_dedup, toxicity
from contentlake.llm import words as W

SCHEMA = "doc_id long, text string, source string, n long, size long, `row` string, id long, tag string, host string"


def docs_of(spark, rows):
    """Rows of (doc_id, text[, source]) with further columns whose names clash with those the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "a", 1, 2, "x", 3, "t", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(count)]


def corpus():
    base = prose(1, 300)
    near = list(base)
    near[150] = "changed"
    rows = [
        (7, " ".join(base)), (3, " ".join(near)), (9, "  ".join(base).upper()), (7, " ".join(base)), (None, " ".join(near[:-3])),
        (11, None), (12, ""), (13, " \n\t "), (14, "only four words here"), (15, "ONLY four\twords here"), (16, "é è " * 40),
        (17, " ".join(prose(5, 30) + base[40:110] + prose(6, 30))), (18, " ".join(base[40:110] * 3)), (19, "x" * 70000),
        (20, " ".join(prose(8, 9000))), (2**63 - 2, "a b c d e f g"), (-5, "a b c d e f g"),
    ]
    return rows + [(100 + k, " ".join(prose(200 + k, 60) + ["tail"] * (k % 3))) for k in range(20)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collected(df):
    return [r.asDict() for r in df.collect()]


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["Aa bb  cc", None, "", "bb", "x\x0by", "aa BB", "é é"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for size in (1, 5, 1 << 20):
        seen = defaultdict(set)
        for part in W.slices(W.text_column(batch, "text"), size):
            found = W.find_words(part)
            hashes = W.word_hashes(part, found, W.byte_codes(fold=True))
            for k in range(part.hi - part.lo):
                own = [lower(w) for w in words_of(texts[part.lo + k])]
                assert len(own) == found.first[k + 1] - found.first[k]
                for w, h in zip(own, hashes[found.first[k] :].tolist(), strict=False):
                    seen[w].add(h)
        assert all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_sliding_minima():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    for width in (1, 7, 499, 500):
        want = [keys[i : i + width].min() for i in range(len(keys) - width + 1)]
        assert minimisers.sliding_minima(keys, width).tolist() == want


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 199)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {199: 199, 200: 199}
    assert common.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_a_hot_node_is_split(spark):
    """The join that sends the members of a large group to their root runs in several tasks."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        edges = spark.range(1, 200_000, numPartitions=8).selectExpr("IF(id < 100000, 0, id) AS a", "id + 1 AS b")
        least = common.saved(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = common.with_least(edges, least).select("b", "m").distinct()
        assert joined.count() == 199_999
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        found = common.components(edges.filter("a = 0"), "a", "b")
        assert found.agg(F.count("*"), F.max("root")).first() == (100_000, 0)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def shingle_set(text, size=5):
    own = [lower(w) for w in words_of(text)]
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def linked_groups(rows, percent=80):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return sets, list(groups.values())


def joined(rows):
    sets, groups = linked_groups(rows)
    out = []
    for group in groups:
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [{"doc_id": rows[k][0], "n_shingles": len(sets[k]), "component_id": min(ids, default=None)} for k in group]
    return out


@pytest.mark.parametrize("settings", [{}, {"rare": -1}, {"rare": -1, "block_sets": 2}, {"sketch_bits": 4}])
def test_ngram_join(spark, settings):
    """rare=-1 makes every shingle frequent (pairs in classes), few sketch cells most of them, block_sets=2 splits cells."""
    rows = corpus()
    rng = random.Random(3)
    base = prose(77, 120)
    for k in range(25):  # a chain of small changes
        rows.append((500 + k, " ".join(base)))
        base[rng.randrange(120)] = f"new{k}"
    same_rows(collected(ngram_join.ngram_join(docs_of(spark, rows), **settings).drop("print")), joined(rows))


def test_ngram_join_hands_on_large_groups(spark):
    entries = [(0, np.array([s], np.uint64).tobytes(), np.array([p], np.int64).tobytes()) for s, p in [(1, 9), (1, 5), (2, 7), (1, 3), (1, 8)]]
    met = ngram_join.meet(spark.createDataFrame(entries, "bucket int, sigs binary, prints binary"), limit=2).collect()
    cells = defaultdict(set)
    for r in met:
        if not r["moved"]:
            cells[r["hub"]] |= {r["hub"], r["print"]}
    for r in met:
        if r["moved"]:
            cells[r["hub"]] |= cells[r["print"]]
    assert {3, 5, 8, 9} in cells.values() and not any(7 in c for c in cells.values())


def test_one_of_each_group(spark):
    rows = corpus()
    kept = ngram_join.one_of_each_group(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    _, groups = linked_groups(rows)
    want = [min((rows[k][0] is not None, rows[k][0] or 0) for k in g) for g in groups]
    same_rows([(r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()], want)


def removed_bytes(rows, length):
    places = Counter()
    documents = {(i, t or "") for i, t, *_ in rows}
    for _, t in documents:
        raw = t.encode()
        places.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if places[raw[k : k + length]] > 1:
                mask[k : k + length] = True
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 4096])
def test_suffix_dedup(spark, most):
    rows = [r for r in corpus() if len(r[1] or "") < 9000] + [(600, "ab" * 90), (601, "z" * 130)]
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows), length=50, gram=12, keep_first=False, most=most, chunk=500)
    same_rows([tuple(r)[:5] for r in got.select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()], removed_bytes(rows, 50))


def test_planted_passages_at_the_settings_of_the_query(spark, tmp_path):
    """Passages of over 50 words in two documents each, the first a byte too short: of the others both copies go, clean texts stay."""
    rows, want = [(100 + k, " ".join(prose(2000 + k, 300))) for k in range(20)], {100 + k: 0 for k in range(20)}
    for k, size in enumerate((399, 400, 401, 800, 1500)):
        passage = " ".join(prose(900 + k, 400))[:size]
        assert len(passage.split()) > 50
        for doc, (a, b) in ((2 * k, "<>"), (2 * k + 1, "[]")):
            own = " ".join(prose(1000 + doc, 120))
            rows.append((doc, own[:250] + a + passage + b + own[250:]))
            want[doc] = size if size >= 400 else 0
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want
    same_rows([tuple(r)[:5] for r in got], removed_bytes(rows, 400))


def test_longest_previous_factors():
    data = np.frombuffer(b"abracadabra-abracadabra-abracadabra" * 3, np.uint8)
    starts = np.arange(len(data) - 16 + 1)
    previous, later = suffix_dedup.factors(data, starts, 16)
    raw = data.tobytes()

    def match(i, j):
        return next((k for k in range(16) if raw[i + k] != raw[j + k]), 16)

    for i in starts.tolist():
        for found, others in ((previous[i], range(i)), (later[i], range(i + 1, len(starts)))):
            best = max((match(i, j) for j in others), default=0)
            assert found == (16 if best == 16 else best // 8 * 8)


def removed_words(rows, length):
    """A document is its (doc_id, text); they go by id (NULL last), then in some fixed order of their texts."""
    order = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    seen, masks = set(), {}
    for none, i, t in order:
        own = words_of(t)
        mask = np.zeros(len(own), bool)
        for k in range(len(own) - length + 1):
            window = tuple(own[k : k + length])
            if window in seen:
                mask[k : k + length] = True
            seen.add(window)
        masks[none, i, t] = mask
    out = []
    for i, t, *_ in rows:
        own, mask = words_of(t), masks[i is None, i or 0, t or ""]
        kept = " ".join(w for w, m in zip(own, mask, strict=True) if not m)
        out.append((i, len(own), int(mask.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 4096])
def test_substring_dedup(spark, most):
    rows = corpus() + [(700, " ".join(["again"] * 60))]
    got = substring_dedup.substring_dedup(docs_of(spark, rows), length=12, gram=4, most=most, chunk=500)
    got = [tuple(r) for r in got.select("doc_id", "n", "n_removed", "kept_sha256").collect()]
    same_rows(got, removed_words(rows, 12))


def test_decontamination(spark):
    rows = corpus() + [(800, "Pre. " + " ".join(prose(1, 300)[20:34]).upper() + "!! post é"), (801, "tiny: Item, here"), (802, "a")]
    items = [(1, " ".join(prose(1, 300)[10:40])), (20, "tiny item"), (3, None), (None, "a b"), (None, " ".join(prose(1, 300)[100:130])), (5, " - "), (6, " ".join(prose(8, 9000)[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t, *_ in rows:
        own, hit, met = cut.findall(lower(t)), set(), set()
        for item, text in items:
            pattern = cut.findall(lower(text))
            for a in range(max(1, len(pattern) - 9) if pattern else 0):
                window = pattern[a : a + 10]
                for k in range(len(own) - len(window) + 1):
                    if own[k : k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        met |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        want.append((i, len(own), len(hit), len(met), digest, bool(hit)))
    for block in (1 << 19, 40):  # one automaton, and several
        got = decontaminate.decontaminate(docs_of(spark, rows), bench, block_bytes=block)
        same_rows([tuple(r)[:6] for r in got.collect()], want)
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    text = "Pre. " + " ".join(prose(1, 300)[20:34]).upper()
    assert [(s["start"], s["end"]) for s in spans[800]] == [(5, len(text))]
    kept = decontaminate.clean_documents(docs_of(spark, rows), bench)
    same_rows([r["doc_id"] for r in kept.collect()], [w[0] for w in want if not w[5]])
    assert decontaminate.decontaminate(docs_of(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


def test_mixing(spark):
    rows = [(k, " ".join(["w"] * (k % 17)), "big") for k in range(400)] + [(k, "one two three", "a") for k in range(500, 520)]
    rows += [(900, "x y", None), (900, "x y", None), (901, None, "none"), (None, "a b c", "Ω")]
    found = collected(mixing.mix(docs_of(spark, rows)))
    again = collected(mixing.mix(docs_of(spark, rows[::-1]).repartition(3)))
    same_rows([(r["doc_id"], r["source"], r["taken"]) for r in found], [(r["doc_id"], r["source"], r["taken"]) for r in again])
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r["size"] == len(words_of(next(t for i, t, s in rows if (i, s) == (r["doc_id"], r["source"])))) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights, left, aims = dict(zip(names, [5, 2, 1, 5, 2], strict=False)), sum(sizes.values()), {}
    while len(aims) < len(names):
        free = [n for n in names if n not in aims]
        share = {n: left * weights[n] / sum(weights[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        aims |= {n: 3 * sizes[n] for n in over} if over else share
        left -= sum(3 * sizes[n] for n in over)
    for n in names:
        assert target[n] == pytest.approx(aims[n]) and abs(taken[n] - aims[n]) < 2 and sizes[n] == {r["source"]: r["source_size"] for r in found}[n]
    mixed = mixing.mixed_documents(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(words_of(r["text"]))
    assert all(abs(words[n] - aims[n]) <= 17 for n in names)


def test_mixing_is_native(spark, folder):
    plan = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding(spark):
    rows = [(k, " ".join(prose(k, 5 + k % 40))) for k in range(600)] + [(1000 + k, "the same text " * 9) for k in range(30)]
    rows += [(2000, "copy " * 400)] * 90 + [(None, None), (5, ""), (5, "")]
    found = collected(sharding.shard(docs_of(spark, rows), shards=4, cells=256))
    same_rows([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows])
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in by[k]) for k in range(4)]
    assert max(sizes) < 1.02 * min(sizes)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    assert len({r["shard"] for r in found if r["doc_id"] and 1000 <= r["doc_id"] < 1030}) == 1  # a group that fits stays together
    assert len({r["shard"] for r in found if r["doc_id"] == 2000}) > 1  # one of more than a shard is dealt out


def test_quality(spark):
    common_line = "All rights  reserved by someone"
    rows = [(k, f"{common_line.upper()}\n" + " ".join(prose(k, 12)), "a") for k in range(12)]
    rows += [(50, f"{common_line}\n one two three four five six seven", None), (51, None, "a"), (52, "a b c d e f g h i j " * 3, "b")]
    rows += [(53, f"all rights reserved by someone\n{common_line}\nx y z q", "a"), (54, "#1 $2 é%\n \n#1 $2 é%\nfour five six seven", "a")]
    got = {r["doc_id"]: r for r in collected(quality.quality(docs_of(spark, rows), line_documents=5, line_percent=20))}
    for i, t, _ in rows:
        own, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        repeated = {k + d for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for d in range(5)}
        r = got[i]
        counts = (len(own), len("".join(own)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert counts == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (len(own) < 10 or 100 * len(repeated) > 20 * len(own))
    assert all(got[k]["n_line_words"] == 5 and got[k]["kept"] for k in range(12))
    assert got[50]["n_line_words"] == 0 and got[50]["kept"]  # another host
    assert got[53]["n_line_words"] == 10 and not got[53]["kept"] and not got[53]["base_failed"]
    assert got[52]["base_failed"] and not got[52]["kept"] and got[51]["base_failed"]


def test_line_dedup(spark):
    rows = [(k, f"Copyright {1990 + k} by the owners of this work\n" + " ".join(prose(k, 8)) + "\n\nend") for k in range(8)]
    rows += [(50, "Copyright 7 by the owners of that work\nmine"), (51, None), (52, " \n"), (53, "Copyright 2000 by nobody at all since long"), (54, "a\r\nb")]
    got = {r["doc_id"]: r for r in collected(line_dedup.line_dedup(docs_of(spark, rows), least_documents=5, agree_percent=80))}
    assert all(got[k]["n_dropped"] == 2 and got[k]["kept_text"] == " ".join(prose(k, 8)) + "\n" for k in range(8))
    assert (got[50]["n_dropped"], got[50]["kept_text"]) == (1, "mine")  # agrees with 7 of 8 fixed places
    assert got[53]["n_dropped"] == 0 and got[52]["kept_text"] == " \n" and got[51]["kept_text"] == "" and got[54]["kept_text"] == "a\r\nb"


def test_line_dedup_keeps_several_templates_in_a_leaf(spark):
    """Lines of nine words that open alike: three equally frequent ones, a frequent one beside another, one among one-off lines, and templates
    no line of which recurs."""

    def filled(opening, k):
        return f"{opening} " + " ".join(f"x{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}{c}" for c in "pqrstu")

    lost = ["click here to read all the terms of use", "click here to see our new offers for today", "click here to join one more list by mail"]
    pair = ["sign up for the weekly letter of this site", "sign up for more daily news about your town"]
    lone = "go back to start page by pressing that key"
    rows = [(100 * k + i, f"{line}\nown") for k, line in enumerate(lost) for i in range(6)]
    rows += [(1000 + i, f"{pair[i > 6]}\nown") for i in range(12)]
    rows += [(2000 + i, f"{lone if i < 8 else filled('go back to', i)}\nown") for i in range(20)]
    loose = [[f"see also the {a} of {b} on page zz{c}" for c in "abcdefgh"] for a, b in (("index", "names"), ("table", "maps"), ("list", "works"))]
    rows += [(3000 + 10 * k + i, f"{line}\nown") for k, own in enumerate(loose) for i, line in enumerate(own)]
    rows += [(4000, f"{lost[1][:-5]}sunday\nown")]  # one word off the second of the three
    gone = {*lost, *pair, lone, rows[-1][1].split("\n")[0], *(line for own in loose for line in own), "own"}
    got = {r["doc_id"]: r["kept_text"] for r in collected(line_dedup.line_dedup(docs_of(spark, rows), least_documents=5))}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t in rows}


def test_line_dedup_keeps_distinct_lines_of_one_opening(spark):
    ends = ["we study graphs", "you meet Anna", "they leave home", "nothing happens yet", "we study trees", "we study rings", "rain falls slowly"]
    rows = [(k, f"In this chapter {end}\nIn this chapter {end.split()[0]}\nSaid the old man {end} again") for k, end in enumerate(ends)]
    rows += [(50 + k, f"On this page: {k} notes\nIn this book {k}") for k in range(5)]
    got = {r["doc_id"]: r for r in collected(line_dedup.line_dedup(docs_of(spark, rows), least_documents=5))}
    assert all(got[k]["n_dropped"] == 0 and got[k]["kept_text"] == rows[k][1] for k in range(len(ends)))
    assert all(got[50 + k]["n_dropped"] == 2 and got[50 + k]["kept_text"] == "" for k in range(5))  # whole masked forms recur


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", r"<\/s> <\\s> [\INST] \ [ < s>", "<s", "", "é\n 漢字 ", "[/INST][/INST]<<s>", "a" * 5000]
    assert all(chat.unescape(chat.escape(t)) == t for t in tricky)
    assert not any(m in chat.escape(t) for t in tricky for m in chat.MARKS)
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)] + [(2, 0, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*r, 5, "y") for r in rows], "conv_id long, turn long, role string, text string, place long, ids string")
    got = {r["conv_id"]: r for r in collected(chat.conversation_digests(chat.format_turns(chat.worst_case(frame))))}
    rows += [(-7, 0, "user", tricky[0]), (-7, 1, "assistant", tricky[0])]
    for key in (1, 2, None, -7):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == key))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[key]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{x}\n" for _, b, x in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(20 + len(chat.escape(b)) + len(chat.escape(x)) for _, b, x in own)
    turns = chat.format_turns(frame).filter("conv_id = 1").orderBy("place").collect()
    assert [t["start"] for t in turns] == np.r_[0, np.cumsum([len(t["ids"]) for t in turns])][:-1].tolist()


def toxic_corpus(count):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(count):
        own = prose(1000 + k, 20 + k % 90, 900)
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                own[rng.randrange(len(own))] = "vile" + rng.choice(["xa", "xo", "xia", "xum", "xen"])
        rows.append((k, " ".join(own)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus(420)
    more = [(5000, None), (5001, ""), (5002, "..."), (None, rows[0][1]), (3, rows[3][1]), (6000, " ".join(prose(9, 3000, 900)) + " vilexut vilexa vile")]
    truth = spark.createDataFrame(labels + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    found = collected(toxicity.toxicity(docs_of(spark, rows + more), truth, epochs=8, rate=0.05))
    assert len(found) == len(rows) + len(more)
    got = {r["doc_id"]: r for r in found}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(got[k]["predicted"] == (k % 3 == 0) for k in held) / len(held) > 0.95
    assert got[5000]["score"] == got[5001]["score"] == got[5002]["score"] == 0 and got[6000]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    # Labels of the held-out fold are never read.
    flipped = truth.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in collected(toxicity.toxicity(docs_of(spark, rows), flipped, epochs=8, rate=0.05))}
    assert all(again[k] == pytest.approx(got[k]["score"]) for k, _ in rows)
    assert toxicity.toxicity(docs_of(spark, rows[:3]), truth.limit(0)).filter("score = 0").count() == 3


def test_network_gradient():
    """The hand-written backward pass agrees with finite differences."""
    shape = toxicity.Shape(window=5, stride=2, width=3, hidden=2, word_bits=4, char_bits=4)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(shape, 1).items()}
    rng = np.random.default_rng(2)
    inputs, numbers = rng.normal(size=(6, 3)), rng.integers(0, 6, (3, 5))
    inside = np.arange(5) < np.array([5, 3, 1])[:, None]
    old = toxicity.F32
    toxicity.F32 = np.float64
    try:
        slope = np.array([1.0, -2.0, 0.5])
        _, kept = toxicity.forward(model, inputs, numbers, inside, keep=True)
        grads, d_inputs = toxicity.backward(model, inputs, numbers, inside, kept, slope)
        for name, array, grad in [(n, model[n], g) for n, g in grads.items()] + [("x", inputs, d_inputs)]:
            for at in list(np.ndindex(array.shape))[:8]:
                keep, ends = array[at], []
                for step in (1e-4, -1e-4):
                    array[at] = keep + step
                    ends.append(float(toxicity.forward(model, inputs, numbers, inside)[0] @ slope))
                array[at] = keep
                assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(float(np.asarray(grad)[at]), abs=2e-3), name
    finally:
        toxicity.F32 = old


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        ngram_join.ngram_join(none), ngram_join.one_of_each_group(none), suffix_dedup.suffix_dedup(none), substring_dedup.substring_dedup(none),
        sharding.shard(none), line_dedup.line_dedup(none), mixing.mix(none), mixing.mixed_documents(none), quality.quality(none),
        decontaminate.decontaminate(none, bench), decontaminate.clean_documents(none, bench), toxicity.toxicity(none, labels),
        toxicity.harmless(none, labels), chat.conversation_digests(chat.format_turns(talks)),
    ):
        assert out.count() == 0


def test_long_texts_are_taken_in_stretches():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for offsets in ([0, 3004], [0, 40, 700, 705, 2990, 3004], [0, 0, 1500, 3004, 3004]):
        want, got = (minimisers.super_runs(grams, np.array(offsets), 20, 5, stretch) for stretch in (1 << 28, 101))

        def windows(runs):
            return {(w, h, t) for a, b, h, t in zip(*(c.tolist() for c in runs), strict=True) for w in range(a, b + 1)}

        assert windows(want) == windows(got) and sum((got.last - got.first + 1).tolist()) == len(windows(got))


SQL_CASES = {
    "three": [f"click here to {end}" for end in ("read all the terms of use", "see our new offers for today", "join one more list by mail")],
    "twelve": [f"we also {a} you the {b} of {c}" for a in ("send", "show") for b in ("news", "maps", "plans") for c in ("home", "town")],
}


@pytest.mark.parametrize("case", ["three", "twelve", "fields", "long"])
def test_line_dedup_equals_its_sql(spark, tmp_path, case):
    """Several templates in a leaf, fields with rare and with frequent values, words off, and lines of 5,000 words."""
    import duckdb

    from contentlake.llm.queries import ORACLE

    rng = random.Random(case)
    if case == "fields":
        lines = [f"posted by {rng.choice(['x', 'y', 'z'])}{rng.randrange(9**6):06d}q on {rng.choice(['monday', 'friday', 'sunday'])} in this forum" for _ in range(90)]
        lines += [f"posted by name{chr(97 + k % 26)}{'abc'[k % 3]}x on some {rng.choice(['wet', 'dry'])} day in this {rng.choice(['forum', 'group'])} here" for k in range(90)]
    elif case == "long":
        base = prose(5, 5000, 3000)
        lines = [" ".join(w if rng.random() > 0.01 else "off" for w in base) for _ in range(24)] + [" ".join(prose(k, 5000)) for k in range(3)]
    else:
        lines = [line for line in SQL_CASES[case] for _ in range(25)]
        lines += [" ".join(rng.choice([w, w, w, w, "other"]) for w in line.split()) for line in lines[::4]]
    rows = [(k, f"{line}\nown words {k}\n\n{rng.choice(lines)}") for k, line in enumerate(lines)] + [(None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "docs")
    docs.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(ORACLE["op5_line_templates"]).fetchall()
    got = line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_dropped"] for r in got) >= 60 or case == "long"
