"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import pytest

import check
import corpus_pipeline
from contentlake.llm import decontaminate, mixing, ngram_join, toxicity
from contentlake.llm.queries import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
import test_operators as ops  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, folder):
    result, _ = check.compare(spark, check.duck(folder), folder, name, QUERIES[name], ORACLE[name])
    assert result.startswith("ok"), result


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1] if kept else docs, folder).cache())
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert ids[0] == sorted(r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect())
    links = ngram_join.ngram_join(kept[0]).collect()
    assert ids[1] == sorted({r["component_id"] for r in links})
    assert ids[2] == sorted(r["doc_id"] for r in decontaminate.decontaminate(kept[1], bench).filter("NOT contaminated").collect())
    mix = mixing.mix(kept[2]).filter("taken > 0").collect()
    assert ids[3] == sorted(r["doc_id"] for r in mix for _ in range(-(-r["taken"] // r["size"])))
    assert ids[4] == ids[3] and {r["shard"] for r in kept[4].collect()} == set(range(16))


def model_of_stages(rows, benchmark, toxic):
    """What each stage but the last keeps, from word sets, dictionaries and loops; ``toxic`` are the rejected (doc_id, text)."""
    first = [r for r in rows if (r[0], r[1]) not in toxic]
    _, groups = ops.linked_groups(first)
    second = [min((first[k] for k in group), key=lambda r: (r[0] is not None, r[0] or 0)) for group in groups]
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for text in benchmark:
        own = cut.findall(ops.lower(text))
        windows |= {tuple(own[a : a + 10]) for a in range(max(1, len(own) - 9) if own else 0)}
    third = []
    for r in second:
        own = cut.findall(ops.lower(r[1]))
        if not any(tuple(own[a : a + len(w)]) == w for w in windows for a in range(len(own) - len(w) + 1)):
            third.append(r)
    sizes = Counter()
    for _, text, source in third:
        sizes[source] += len(ops.words_of(text))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights, left, aims = dict(zip(names, [5, 2, 1] * 9, strict=False)), sum(sizes.values()), {}
    while len(aims) < len(names):
        free = [n for n in names if n not in aims]
        share = {n: left * weights[n] / sum(weights[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        aims |= {n: 3 * sizes[n] for n in over} if over else share
        left -= sum(3 * sizes[n] for n in over)
    fourth = []
    for name in names:
        own = [r for r in third if r[2] == name]
        key = {r: hashlib.md5(f"mix|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest() for r in own}
        budget, taken = int(aims[name] + 1e-9), 0
        while sizes[name] and taken < budget:
            for r in sorted(own, key=key.get):
                if taken < budget:
                    fourth.append(r)
                    taken += len(ops.words_of(r[1]))
        # Documents without words move no sum: they come with every epoch, whole or begun, that reaches their key.
    return first, second, third, fourth


def test_pipeline_equals_a_plain_model(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        own = ops.prose(3000 + k, 25 + k % 50, 900)
        if k % 4 == 0:
            for _ in range(3):
                own[rng.randrange(len(own))] = "vile" + rng.choice(["xa", "xo", "xia", "xum"])
        rows.append((k, " ".join(own), rng.choice(["hot", "hot", "hot", "b", "c", None])))
    base = rows[1][1].split()
    rows += [(200, " ".join(base), "b"), (201, " ".join(base[:-1] + ["end"]), "c"), (None, " ".join(base), "b"), (3, rows[3][1], rows[3][2])]
    questions = [" ".join(ops.prose(7000 + k, 14)) for k in range(5)] + ["ab cd"]
    rows += [(300 + k, f"{' '.join(ops.prose(8000 + k, 20))} {questions[k % 6].upper()} {' '.join(ops.prose(9000 + k, 9))}", "hot") for k in range(9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(150) if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, q) for k, q in enumerate(questions)] + [(None, questions[0]), (77, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).withColumnRenamed("doc_id", "i").collect()
    predicted = {r["i"]: r["predicted"] for r in scored}
    wanted = model_of_stages(rows, questions, {(i, t) for i, t, _ in rows if predicted[i]})
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        kept = stage(spark, kept, folder).cache()
        got = [(r["doc_id"], r["text"], r["source"]) for r in kept.select("doc_id", "text", "source").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
    assert 0 < len(wanted[2]) < len(wanted[1]) < len(wanted[0]) < len(rows)
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), len((t or "").encode()) + 1) for i, t, _ in wanted[3])
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, NULL ids, texts and sources, and repeated rows through all five stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, "some words", None, None, None), (None, None, None, "a", 1), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (6, "one two three", "x", "b", 3)] * 2
    for name, rows in (("empty", []), ("odd", odd)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in out} >= ({6} if rows else set()) and len(out) <= 3 * len(rows)
